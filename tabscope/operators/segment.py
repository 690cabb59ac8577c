"""Pareto segmentation.

Entity totals come from one grouped aggregation (map-side partial sums, so a
hot entity does not skew the shuffle). The running share over all entities in
descending order is a global prefix sum, computed with the range-partitioned
two-level scheme of ``functions.ordering`` instead of one un-partitioned window.
``pareto_split`` needs no order: it selects the place where the share is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import missing_safe
from ..functions.ordering import with_global_running_sum


def entity_totals(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Sum of ``value_col`` per non-missing ``id_col`` (A30); an all-missing group sums to 0."""
    idv = missing_safe(df, id_col)
    v = missing_safe(df, value_col).cast("double")
    return (df.filter(idv.isNotNull()).groupBy(idv.alias("entity"))
            .agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("total")))


def pareto_segments(df: DataFrame, id_col: str, value_col: str, threshold: float = 80.0,
                    parts: int | None = None) -> DataFrame:
    """Per entity: total, running total in (total desc, entity asc) order, running
    share of the grand total in %, and ``Top`` (≤ threshold) / ``Bottom`` (W2)."""
    totals = entity_totals(df, id_col, value_col)
    order = [F.col("total").desc(), F.col("entity").asc()]
    run = with_global_running_sum(totals, order, "total", out="cumulative_value", pos="rank",
                                  parts=parts)
    # the entity table is materialised by the checkpoint above, so the grand total
    # reads it instead of the raw data
    grand = run.agg(F.sum("total")).first()[0] or 0.0
    pct = (F.lit(0.0) if grand == 0 else F.col("cumulative_value") / F.lit(grand) * 100.0)
    return (run.withColumn("cumulative_pct", pct)
            .withColumn("segment", F.when(F.col("cumulative_pct") <= threshold, F.lit("Top"))
                        .otherwise(F.lit("Bottom")))
            .select("entity", "total", "rank", "cumulative_value", "cumulative_pct", "segment"))


#: Bins of a selection round, and the totals that may be read one by one at its end.
BINS, LAST = 1024, 10_000


def _split_at(totals: DataFrame, target: float, last: int = LAST) -> tuple[list, list]:
    """``[count, sum]`` of the largest totals whose running sum stays within ``target``, and of the others.

    Each round sums the open totals by bin (logarithmic at first, then even), of which only the
    one that crosses the target stays open, so nothing is sorted; a few rounds leave one value or
    at most ``last`` totals. Equal totals need no order among them. The positive totals sum to
    more than ``target``, which is not negative."""
    x = F.col("total")
    top, rest = [0, 0.0], [0, 0.0]

    def add(to: list, n: int, value: float) -> None:
        to[0] += n
        to[1] += value

    r = totals.agg(F.count_if(x <= 0).alias("n"), F.coalesce(F.sum(F.when(x <= 0, x)), F.lit(0.0)).alias("s"),
                   F.min(F.when(x > 0, x)).alias("lo"), F.max(x).alias("hi")).first()
    add(rest, r["n"], r["s"])
    lo, hi, place, crossed = r["lo"], r["hi"], F.log, False
    open_ = totals.filter(x > 0)
    while not crossed:
        span = F.greatest(place(F.lit(hi)) - place(F.lit(lo)), F.lit(1e-300))
        at = F.least(F.floor((place(x) - place(F.lit(lo))) / span * BINS), F.lit(BINS - 1))
        bins = open_.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.min(x).alias("lo"),
                                                 F.max(x).alias("hi")).collect()          # at most BINS rows
        crossing = None
        for b in sorted(bins, key=lambda b: -b["hi"]):
            if crossing is not None:
                add(rest, b["n"], b["s"])
            elif top[1] + b["s"] <= target:
                add(top, b["n"], b["s"])
            else:
                crossing = b
        if crossing is None:                                  # the sums differ in the last digits only
            return top, rest
        lo, hi = crossing["lo"], crossing["hi"]
        open_, place = totals.filter(x.between(lo, hi)), lambda c: c
        crossed = lo == hi or crossing["n"] <= last
    full = False
    for v in sorted(open_.groupBy(x).count().collect(), key=lambda v: -v["total"]):
        k = 0 if full else min(v["count"], max(0, int((target - top[1]) // v["total"])))
        full = k < v["count"]                                 # smaller totals come after those left out
        add(top, k, k * v["total"])
        add(rest, v["count"] - k, (v["count"] - k) * v["total"])
    return top, rest


def pareto_split(df: DataFrame, id_col: str, value_col: str, threshold: float = 80.0) -> DataFrame:
    """The rows of ``pareto_summary`` without a sort of the entities.

    A weighted selection over the entity totals finds the place where the share is reached.
    Sums are added bin by bin, so their last digits differ from those added in order. Where
    running shares may fall again (no positive grand total, a threshold of 100 or more) or are
    not finite, the summary of the ordered entities is given."""
    totals = entity_totals(df, id_col, value_col).persist()
    try:
        t = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("v")).first()
        n, v = t["n"], t["v"] or 0.0
        if math.isfinite(v) and v > 0 and 0 <= threshold < 100:
            parts = zip(("Top", "Bottom"), _split_at(totals, threshold / 100.0 * v))
            return df.sparkSession.createDataFrame(
                [(name, k, k * 100.0 / n, s, s * 100.0 / v) for name, (k, s) in parts if k],
                "segment string, entities bigint, pct_entities double, value double, pct_value double")
    finally:
        totals.unpersist()
    return pareto_summary(df, id_col, value_col, threshold)


def pareto_summary(df: DataFrame, id_col: str, value_col: str, threshold: float = 80.0) -> DataFrame:
    """Per segment: entities, % of entities, total value and % of value."""
    seg = pareto_segments(df, id_col, value_col, threshold)
    g = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("entities"), F.sum("total").alias("value"))
    tot = seg.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("v")).first()
    n, v = tot["n"], tot["v"] or 0.0
    return g.select("segment", "entities",
                    (F.col("entities") * 100.0 / F.lit(n)).alias("pct_entities"), "value",
                    (F.lit(0.0) if v == 0 else F.col("value") * 100.0 / F.lit(v)).alias("pct_value"))


def segmentation_report(df: DataFrame, id_col: str | None = None, value_col: str | None = None,
                        threshold: float = 80.0) -> DataFrame:
    """Segmentation (M8): the entity column (R2) and value column (R3) are detected
    when not given, then the Pareto summary (W3) is selected without a sort."""
    from .detect import _first, detect_entity_column, detect_value_column
    id_col = id_col or _first(detect_entity_column(df))
    value_col = value_col or _first(detect_value_column(df))
    if id_col is None or value_col is None:
        raise ValueError("no entity/value column detected; pass id_col and value_col")
    return (pareto_split(df, id_col, value_col, threshold)
            .withColumn("id_column", F.lit(id_col)).withColumn("value_column", F.lit(value_col)))
