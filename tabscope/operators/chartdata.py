"""The aggregated data behind the reference's charts.

No figure is drawn: each function returns the small table a plotting library
would need (histogram bars, density curve, box statistics, binned scatter).
Point-level charts become deterministic samples. Infinite values are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import missing_safe, normalize_missing, quote
from ..functions.sampling import bottom_k, bottom_k_by
from ..functions.stats import quantiles
from ..functions.typeclass import numeric_columns
from .profile import top_values


def _x(df: DataFrame, name: str) -> Column:
    return missing_safe(df, name).cast("double")


def finite(x: Column) -> Column:
    """``x`` with infinite values as missing: charts leave them out, as they do missing ones."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def hist_range(lo: float | None, hi: float | None) -> tuple[float | None, float | None]:
    """numpy's histogram range: a constant column spans [v − 0.5, v + 0.5]."""
    if lo is None:
        return None, None
    if lo == hi:
        return lo - 0.5, hi + 0.5
    return lo, hi


def hist_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """numpy bin index: left-closed bins, the last one closed on the right."""
    norm = bins / (hi - lo)
    idx = F.floor((x - F.lit(lo)) * F.lit(norm))
    return F.when(x.isNotNull(), F.least(idx, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram (A19) of the finite values: every bin, empty ones with count 0."""
    x = finite(_x(df, col))
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = hist_range(r["lo"], r["hi"])
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    counts = (df.select(hist_bin(x, lo, hi, bins).alias("bin")).filter(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    width = (hi - lo) / bins
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(F.broadcast(counts), "bin", "left")            # ≤ bins rows
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi))
                    .otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
            .orderBy("bin"))


#: Bandwidths from a value to the last grid point its kernel is added to (exp(-0.5 * 9 ** 2) is 3e-18).
KERNEL_REACH = 9.0


def kde_curve(df: DataFrame, col: str, grid: int = 200, exact: bool = False,
              bins_per_bandwidth: int = 64) -> DataFrame:
    """Gaussian kernel density of the finite values on ``grid`` points from min to max.

    Bandwidth is Scott's rule n^(−1/5)·std (sample std). ``exact`` sums one kernel
    per row (each row contributes to every grid point, pre-aggregated per
    partition before the shuffle); by default rows are first reduced to
    weighted bin centres whose width is the bandwidth over ``bins_per_bandwidth``
    (relative error about 1e-5, whatever the column's tails), so the kernel work
    is per occupied bin. A value meets the grid points within ``KERNEL_REACH``
    bandwidths, beyond which its kernel is below the doubles' precision.
    ``count_density`` is scaled to counts (density × n)."""
    x = finite(_x(df, col))
    r = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
               F.stddev_samp(x).alias("sd")).first()
    spark = df.sparkSession
    schema = "point int, x double, density double, count_density double"
    n, lo, hi, sd = r["n"], r["lo"], r["hi"], r["sd"]
    if not n or n < 2 or not sd:
        return spark.createDataFrame([], schema)
    bw = sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (grid - 1)
    if exact:
        pts = df.select(x.alias("v"), F.lit(1).cast("long").alias("w")).filter(F.col("v").isNotNull())
    else:
        fw = bw / bins_per_bandwidth
        b = F.floor((x - F.lit(lo)) / F.lit(fw))
        pts = (df.filter(x.isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("w"))
               .select((F.lit(lo) + (F.col("b") + 0.5) * F.lit(fw)).alias("v"), "w"))
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    place = (F.col("v") - F.lit(lo)) / F.lit(step)
    near = F.lit(KERNEL_REACH * bw / step)
    first = F.greatest(F.ceil(place - near), F.lit(0)).cast("int")
    last = F.least(F.floor(place + near), F.lit(grid - 1)).cast("int")
    met = pts.filter(first <= last).select("v", "w", F.explode(F.sequence(first, last)).alias("point"))
    contrib = met.select("point", (F.col("w") * F.exp(-0.5 * F.pow(
        (F.lit(lo) + F.col("point") * F.lit(step) - F.col("v")) / F.lit(bw), 2))).alias("k"))
    # every point is there, also one that no value reaches
    contrib = contrib.unionAll(spark.range(grid).select(F.col("id").cast("int"), F.lit(0.0)))
    dens = contrib.groupBy("point").agg((F.sum("k") * F.lit(norm)).alias("density"))
    return dens.select(F.col("point").cast("int"),
                       (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), "density",
                       (F.col("density") * F.lit(float(n))).alias("count_density")).orderBy("point")


def _box_aggs(x: Column, lo: float, hi: float) -> list[Column]:
    return [F.count(x).alias("n"),
            F.min(F.when(x >= F.lit(lo), x)).alias("whisker_low"),
            F.max(F.when(x <= F.lit(hi), x)).alias("whisker_high"),
            F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias("fliers")]


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Box-plot numbers (A17): quartiles, whiskers at the furthest values within
    1.5·IQR of the box, and the number of fliers beyond them."""
    x = _x(df, col)
    q = quantiles(normalize_missing(df.select(quote(col))), [col], [0.25, 0.5, 0.75])
    q1, med, q3 = q[(None, col, 0.25)], q[(None, col, 0.5)], q[(None, col, 0.75)]
    if q1 is None:
        return df.sparkSession.createDataFrame(
            [], "column_name string, n bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, fliers bigint")
    iqr = q3 - q1
    agg = df.agg(*_box_aggs(x, q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    return agg.select(F.lit(col).alias("column_name"), "n", F.lit(q1).alias("q1"),
                      F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                      "whisker_low", "whisker_high", "fliers")


def box_stats_by_category(df: DataFrame, cat: str, col: str, top: int = 15) -> DataFrame:
    """Box-plot numbers of ``col`` per category for the ``top`` most frequent
    categories (A18): one quantile computation for all groups, then one grouped
    aggregation with each group's own whisker bounds."""
    keep = top_values(df, cat, top)
    schema = ("category string, n bigint, q1 double, median double, q3 double, "
              "whisker_low double, whisker_high double, fliers bigint")
    if not keep:
        return df.sparkSession.createDataFrame([], schema)
    v = missing_safe(df, cat)
    sub = df.filter(v.isin(keep)).select(v.alias("_g"), _x(df, col).alias("_x"))
    q = quantiles(sub, ["_x"], [0.25, 0.5, 0.75], by="_g", groups=keep)
    lo_map, hi_map, vals = [], [], []
    for g in keep:
        q1, med, q3 = q[(g, "_x", 0.25)], q[(g, "_x", 0.5)], q[(g, "_x", 0.75)]
        if q1 is None:
            continue
        iqr = q3 - q1
        lo_map += [F.lit(g), F.lit(q1 - 1.5 * iqr)]
        hi_map += [F.lit(g), F.lit(q3 + 1.5 * iqr)]
        vals += [F.lit(g), F.array(F.lit(q1), F.lit(med), F.lit(q3))]
    if not vals:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = F.create_map(*lo_map)[F.col("_g")], F.create_map(*hi_map)[F.col("_g")]
    xs = F.col("_x")
    agg = sub.groupBy("_g").agg(
        F.count(xs).alias("n"), F.min(F.when(xs >= lo, xs)).alias("whisker_low"),
        F.max(F.when(xs <= hi, xs)).alias("whisker_high"),
        F.count_if((xs < lo) | (xs > hi)).alias("fliers"))
    qv = F.create_map(*vals)[F.col("_g")]
    return (agg.filter(qv.isNotNull())
            .select(F.col("_g").cast("string").alias("category"), "n", qv[0].alias("q1"),
                    qv[1].alias("median"), qv[2].alias("q3"), "whisker_low", "whisker_high", "fliers")
            .orderBy("category"))


def density_2d(df: DataFrame, x: str, y: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Binned scatter (A31): counts per (x bin, y bin[, facet]) with histogram bins."""
    xs, ys = finite(_x(df, x)), finite(_x(df, y))
    r = df.agg(F.min(xs).alias("xl"), F.max(xs).alias("xh"), F.min(ys).alias("yl"),
               F.max(ys).alias("yh")).first()
    xl, xh = hist_range(r["xl"], r["xh"])
    yl, yh = hist_range(r["yl"], r["yh"])
    keys = []
    if by is not None:
        keys.append(missing_safe(df, by).alias(by))
    if xl is None or yl is None:
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, count bigint")
    keys += [hist_bin(xs, xl, xh, bins).alias("bin_x"), hist_bin(ys, yl, yh, bins).alias("bin_y")]
    both = xs.isNotNull() & ys.isNotNull()
    return df.filter(both).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def density_3d(df: DataFrame, x: str, y: str, z: str, bins: int = 10) -> DataFrame:
    """Binned counts over three numeric columns (A31); at most ``bins``³ rows."""
    spans = {}
    r = df.agg(*[e for i, c in enumerate((x, y, z)) for e in (F.min(finite(_x(df, c))).alias(f"lo{i}"),
                                                              F.max(finite(_x(df, c))).alias(f"hi{i}"))]).first()
    for i, c in enumerate((x, y, z)):
        spans[c] = hist_range(r[f"lo{i}"], r[f"hi{i}"])
    names = ("bin_x", "bin_y", "bin_z")
    if any(spans[c][0] is None for c in spans):
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, bin_z int, count bigint")
    binned = df.select(*[hist_bin(finite(_x(df, c)), *spans[c], bins).alias(n) for c, n in zip((x, y, z), names)])
    return binned.filter(" and ".join(f"{n} is not null" for n in names)).groupBy(*names).agg(
        F.count(F.lit(1)).alias("count"))


def pair_plot(df: DataFrame, first: int = 5, bins: int = 30) -> DataFrame:
    """Binned scatters of all pairs of the ``first`` numeric columns and, as a pair of
    itself, each column's histogram on the diagonal (A31)."""
    cols = numeric_columns(df)[:first]
    return density_pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]], bins)


def scatter_sample(df: DataFrame, cols: list[str], n: int = 1000, seed: int = 42,
                   by: str | None = None, per_group: int | None = None) -> DataFrame:
    """Deterministic uniform sample of ``n`` points for point-level charts (L5); equal points are
    drawn as often as they occur. With ``by``, ``per_group`` rows per category."""
    keep = list(dict.fromkeys(cols + ([by] if by else [])))
    points = df.select(*[quote(c) for c in keep])
    return bottom_k(points, n, seed) if by is None else bottom_k_by(points, by, per_group or n, seed)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-missing values of a column, sorted."""
    v = missing_safe(df, col)
    return df.select(v.alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")


def histograms(df: DataFrame, cols: list[str], bins: int = 30, ranges: dict | None = None) -> DataFrame:
    """Histograms of many numeric columns with one shuffle: each row is unpivoted
    to ``(column, bin)`` and counted (partial aggregation per column and bin).
    ``ranges`` = ``{col: (min, max)}`` when already known; empty bins included."""
    spark = df.sparkSession
    ddl = "column_name string, bin int, bin_start double, bin_end double, count bigint"
    if not cols:
        return spark.createDataFrame([], ddl)
    if ranges is None:
        r = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(finite(_x(df, c))).alias(f"lo{i}"),
                                                             F.max(finite(_x(df, c))).alias(f"hi{i}"))]).first()
        ranges = {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)}
    spans = {c: hist_range(*ranges[c]) for c in cols}
    live = [c for c in cols if spans[c][0] is not None]
    if not live:
        return spark.createDataFrame([], ddl)
    entries = F.array(*[F.struct(F.lit(c).alias("c"), hist_bin(finite(_x(df, c)), *spans[c], bins).alias("b"))
                        for c in live])
    counts = (df.select(F.explode(entries).alias("e")).filter(F.col("e.b").isNotNull())
              .groupBy(F.col("e.c").alias("column_name"), F.col("e.b").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    frame_rows = []
    for c in live:
        lo, hi = spans[c]
        w = (hi - lo) / bins
        frame_rows += [(c, b, lo + b * w, hi if b == bins - 1 else lo + (b + 1) * w) for b in range(bins)]
    frame = spark.createDataFrame(frame_rows, "column_name string, bin int, bin_start double, bin_end double")
    return (frame.join(counts, ["column_name", "bin"], "left")      # frame: len(cols) × bins rows
            .select("column_name", "bin", "bin_start", "bin_end",
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats_many(df: DataFrame, cols: list[str], quartiles: dict | None = None) -> DataFrame:
    """Box-plot numbers for many columns: one quantile run, one aggregation."""
    from ..functions.aggs import agg_row
    ddl = ("column_name string, n bigint, q1 double, median double, q3 double, whisker_low double, "
           "whisker_high double, fliers bigint")
    if not cols:
        return df.sparkSession.createDataFrame([], ddl)
    if quartiles is None:
        q = quantiles(normalize_missing(df.select(*[quote(c) for c in cols])), cols, [0.25, 0.5, 0.75])
        quartiles = {c: (q[(None, c, 0.25)], q[(None, c, 0.5)], q[(None, c, 0.75)]) for c in cols}
    named = []
    for i, c in enumerate(cols):
        q1, _, q3 = quartiles[c]
        if q1 is None:
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = _x(df, c)
        named += [(f"n{i}", F.count(x), 1), (f"wl{i}", F.min(F.when(x >= F.lit(lo), x)), 1),
                  (f"wh{i}", F.max(F.when(x <= F.lit(hi), x)), 1),
                  (f"f{i}", F.count_if((x < F.lit(lo)) | (x > F.lit(hi))), 1)]
    r = agg_row(df, named) if named else {}
    rows = [(c, r[f"n{i}"], *quartiles[c], r[f"wl{i}"], r[f"wh{i}"], r[f"f{i}"])
            for i, c in enumerate(cols) if quartiles[c][0] is not None]
    return df.sparkSession.createDataFrame(rows, ddl)


def density_pairs(df: DataFrame, pairs: list[tuple[str, str]], bins: int = 30,
                  ranges: dict | None = None) -> DataFrame:
    """Binned scatter counts for several column pairs with one shuffle."""
    spark = df.sparkSession
    ddl = "col_x string, col_y string, bin_x int, bin_y int, count bigint"
    if not pairs:
        return spark.createDataFrame([], ddl)
    cols = sorted({c for p in pairs for c in p})
    if ranges is None:
        r = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(finite(_x(df, c))).alias(f"lo{i}"),
                                                             F.max(finite(_x(df, c))).alias(f"hi{i}"))]).first()
        ranges = {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)}
    spans = {c: hist_range(*ranges[c]) for c in cols}
    live = [(a, b) for a, b in pairs if spans[a][0] is not None and spans[b][0] is not None]
    if not live:
        return spark.createDataFrame([], ddl)
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                 hist_bin(finite(_x(df, a)), *spans[a], bins).alias("bx"),
                                 hist_bin(finite(_x(df, b)), *spans[b], bins).alias("by")) for a, b in live])
    return (df.select(F.explode(entries).alias("e"))
            .filter(F.col("e.bx").isNotNull() & F.col("e.by").isNotNull())
            .groupBy(F.col("e.a").alias("col_x"), F.col("e.b").alias("col_y"),
                     F.col("e.bx").alias("bin_x"), F.col("e.by").alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("count")))
