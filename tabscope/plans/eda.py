"""Exploratory analysis (M4) planned as a few shared passes.

Every chart of the reference's exploratory page needs statistics that other
charts need too; computing them per chart would scan the table dozens of
times. Here the parts share:

* one numeric aggregation (count, mean, min, max of every numeric column) and
  one exact-quantile run (quartiles and medians of every numeric column);
* one value-count shuffle over all text columns (persisted), from which the
  top values, bar and pie tables, distinct counts and the category-column
  choices (R7–R9) are all derived — per-column top-k ranks use Spark's window
  group limit, so only k rows per column and map partition are shuffled;
* one correlation computation, whose small result also gives the top pairs,
  then one aggregation for all trend lines and one shuffle for all binned
  scatters.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import missing_safe, normalize_missing, quote
from ..functions.stats import quantiles
from ..functions.typeclass import categorical_columns, numeric_columns
from ..operators import chartdata, relations
from ..operators.profile import top_of_each, value_counts_long


def _category_tables(df: DataFrame, vc: DataFrame, k_bars: int, k_pie: int, k_groups: int) -> dict:
    """Top values, bars (+Other), pie slices (+Other, %) per column from the VC core."""
    top = top_of_each(df, vc, max(k_bars, k_pie, k_groups))
    per_col = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"),
                                            F.sum("count").alias("total"))

    def with_other(n: int) -> DataFrame:
        kept = top.filter(F.col("rank") <= n)
        kept_sum = kept.groupBy("column_name").agg(F.sum("count").alias("kept"))
        other = (per_col.join(kept_sum, "column_name")
                 .filter((F.col("distinct") > n) & (F.col("total") > F.col("kept")))
                 .select("column_name", F.lit("Other").alias("value"),
                         (F.col("total") - F.col("kept")).alias("count")))
        # a real value "Other" among the top shares the remainder's row (as in topn_other)
        return kept.select("column_name", "value", "count").unionByName(other).groupBy(
            "column_name", "value").agg(F.sum("count").cast("bigint").alias("count"))

    bars = with_other(k_bars)
    pie = with_other(k_pie).join(per_col.select("column_name", "total"), "column_name")
    pie = (pie.withColumn("pct", F.col("count") * 100.0 / F.col("total"))
           .withColumn("label_shown", F.col("pct") >= 1.0).drop("total"))
    return {"top": top, "bars": bars, "pie": pie, "per_col": per_col}


def eda_numeric_extras(df: DataFrame, nums: list[str]) -> list:
    """Plain statistics the EDA needs per numeric column (mean, min, max and the
    correlation pre-pass); they ride along in the first quantile pass."""
    return ([e for i, c in enumerate(nums) for e in (
        (f"a{i}", F.avg(missing_safe(df, c).cast("double")), 2),
        (f"lo{i}", F.min(missing_safe(df, c).cast("double")), 1),
        (f"hi{i}", F.max(missing_safe(df, c).cast("double")), 1))]
        + (relations.corr_pre_aggregates(df, nums) if 2 <= len(nums) < relations.WIDE else []))


def eda_report(df: DataFrame, top_pairs: int = 3, max_bars: int = 20, max_slices: int = 10,
               bins: int = 30, vc: DataFrame | None = None, numeric: dict | None = None,
               quantile_method: str = "exact", group_top: int = 20, box_top: int = 15,
               box_columns: int = 3, facet_plain: int = 20, facet_top: int = 20) -> dict:
    """Parts of the exploratory analysis as DataFrames (long form, one table per
    chart kind with a ``column_name`` column). Bars and slices, the categories of
    group means (``group_top``), of grouped boxes (``box_top`` categories, ``box_columns``
    numeric columns) and of facets (all up to ``facet_plain`` values, else the first
    ``facet_top`` and Other) are limited independently."""
    df = normalize_missing(df)
    spark = df.sparkSession
    nums = numeric_columns(df)
    cats = categorical_columns(df)
    parts: dict = {}

    ranges: dict = {}
    if nums:
        q = numeric if numeric is not None else quantiles(
            df.select(*[quote(c) for c in nums]), nums, [0.25, 0.5, 0.75], extra=eda_numeric_extras(df, nums),
            method=quantile_method)
        st = q["__extra__"]
        quart = {c: (q[(None, c, 0.25)], q[(None, c, 0.5)], q[(None, c, 0.75)]) for c in nums}
        ranges = {c: (st[f"lo{i}"], st[f"hi{i}"]) for i, c in enumerate(nums)}
        parts["numeric_summary"] = spark.createDataFrame(
            [(i, c, st[f"a{i}"], quart[c][1], st[f"lo{i}"], st[f"hi{i}"]) for i, c in enumerate(nums)],
            "position int, column_name string, mean double, median double, min double, max double")
        parts["box_stats"] = chartdata.box_stats_many(df, nums, quart)

    distinct: dict = {}
    tops: dict = {}
    if cats:
        vc = (value_counts_long(df, cats, compact=True).persist(StorageLevel.MEMORY_AND_DISK) if vc is None
              else vc.filter(F.col("column_name").isin(cats)))
        tables = _category_tables(df, vc, max_bars, max_slices, max(group_top, box_top, facet_top))
        parts["value_counts"] = tables["top"].filter(F.col("rank") <= max_bars)
        parts["bars"] = tables["bars"]
        parts["pies"] = tables["pie"]
        distinct = {r["column_name"]: r["distinct"] for r in tables["per_col"].collect()}
        for r in tables["top"].orderBy("column_name", "rank").collect():   # few per column
            tops.setdefault(r["column_name"], []).append(r["value"])

    pairs: list = []
    facet_spec = None
    if len(nums) >= 2:
        sums = relations.PairSums(df, nums, pre=st)
        cm = relations.corr_matrix(df, nums, sums=sums)
        rows = [r for r in cm.collect() if r["pos_a"] < r["pos_b"] and r["r"] is not None and abs(r["r"]) < 1]
        rows.sort(key=lambda r: (-abs(r["r"]), r["pos_a"], r["pos_b"]))
        top = rows[:top_pairs]
        pairs = [(r["col_a"], r["col_b"]) for r in top]
        parts["corr_matrix"] = cm
        parts["top_corr_pairs"] = spark.createDataFrame(
            [(r["col_a"], r["col_b"], r["r"], abs(r["r"])) for r in top],
            "col_a string, col_b string, r double, abs_r double")
        if pairs:
            # trend lines come from the same sums: no extra pass
            lines = [(r["col_a"], r["col_b"], *(sums.line(r["pos_a"], r["pos_b"]) or (None,) * 4))
                     for r in top]
            parts["trends"] = spark.createDataFrame(
                lines, "x string, y string, slope double, intercept double, r2 double, n bigint")

    if cats and nums:
        box_cat = next((c for c in cats if distinct.get(c, 0) < 15), None)          # R9
        if box_cat:
            parts["box_by_category"] = _box_by_category(df, box_cat, nums[:box_columns], tops.get(box_cat, [])[:box_top])
        group_cat = next((c for c in cats if 2 <= distinct.get(c, 0) <= 20), cats[0])  # R7
        keep = tops.get(group_cat, [])[:group_top]
        g = missing_safe(df, group_cat)
        parts["group_means"] = (df.filter(g.isin(keep)).groupBy(g.alias("category"))
                                .agg(*[F.avg(missing_safe(df, c).cast("double")).alias(c) for c in nums])
                                .withColumn("column_name", F.lit(group_cat)))
        if len(nums) >= 2:
            facet = next((c for c in cats if 2 <= distinct.get(c, 0) <= 10), cats[0])  # R8
            xa, ya = pairs[0] if pairs else (nums[0], nums[1])
            fv = missing_safe(df, facet)
            label = fv if distinct.get(facet, 0) <= facet_plain else F.when(
                fv.isin(tops.get(facet, [])[:facet_top]), fv).otherwise(F.lit("Other"))
            facet_spec = (facet, label, xa, ya)
    if nums:
        parts.update(_binned_parts(df, nums, pairs, facet_spec, ranges, bins))
    return parts


def _binned_parts(df: DataFrame, nums: list[str], pairs: list, facet_spec, ranges: dict, bins: int) -> dict:
    """Histograms of every numeric column, binned scatters of the top pairs and the
    faceted scatter from one explode and one shuffle. The counted table has at most
    ``bins`` rows per column and ``bins²`` per pair and facet, so it is persisted."""
    spark = df.sparkSession
    spans = {c: chartdata.hist_range(*ranges[c]) for c in nums}
    ok = {c for c in nums if spans[c][0] is not None}

    def b(c):
        return chartdata.hist_bin(missing_safe(df, c).cast("double"), *spans[c], bins)

    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def entry(kind, cx, cy, facet, bx, by):
        return F.struct(F.lit(kind).alias("kind"), F.lit(cx).alias("col_x"),
                        (F.lit(cy) if cy else none_s).alias("col_y"), facet.alias("facet"),
                        bx.alias("bin_x"), by.alias("bin_y"))

    entries = [entry("hist", c, None, none_s, b(c), none_i) for c in nums if c in ok]
    entries += [entry("pair", a, c, none_s, b(a), b(c)) for a, c in pairs if a in ok and c in ok]
    if facet_spec and facet_spec[2] in ok and facet_spec[3] in ok:
        facet, label, xa, ya = facet_spec
        entries.append(entry("facet", xa, ya, label.cast("string"), b(xa), b(ya)))
    out: dict = {}
    hist_ddl = "column_name string, bin int, bin_start double, bin_end double, count bigint"
    if not entries:
        out["histograms"] = spark.createDataFrame([], hist_ddl)
        return out
    binned = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
              .filter(F.col("bin_x").isNotNull() & ((F.col("kind") == "hist") | F.col("bin_y").isNotNull()))
              .groupBy("kind", "col_x", "col_y", "facet", "bin_x", "bin_y")
              .agg(F.count(F.lit(1)).alias("count"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    frame_rows = []
    for c in nums:
        if c in ok:
            lo, hi = spans[c]
            w = (hi - lo) / bins
            frame_rows += [(c, k, lo + k * w, hi if k == bins - 1 else lo + (k + 1) * w) for k in range(bins)]
    frame = spark.createDataFrame(frame_rows, "column_name string, bin int, bin_start double, bin_end double")
    hist = binned.filter(F.col("kind") == "hist").select(F.col("col_x").alias("column_name"),
                                                         F.col("bin_x").alias("bin"), "count")
    out["histograms"] = (frame.join(hist, ["column_name", "bin"], "left")
                         .select("column_name", "bin", "bin_start", "bin_end",
                                 F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
    if pairs:
        out["scatter"] = (binned.filter(F.col("kind") == "pair")
                          .select("col_x", "col_y", "bin_x", "bin_y", "count"))
    if facet_spec:
        out["facets"] = (binned.filter(F.col("kind") == "facet")
                         .select("facet", "bin_x", "bin_y", "count", F.lit(facet_spec[0]).alias("facet_column"),
                                 "col_x", "col_y"))
    return out


def _box_by_category(df: DataFrame, cat: str, cols: list[str], keep: list) -> DataFrame:
    """Box numbers of several columns per top category: one quantile run, one grouped aggregation."""
    ddl = ("column_name string, category string, n bigint, q1 double, median double, q3 double, "
           "whisker_low double, whisker_high double, fliers bigint")
    spark = df.sparkSession
    if not keep:
        return spark.createDataFrame([], ddl)
    v = missing_safe(df, cat)
    sub = df.filter(v.isin(keep)).select(v.alias("_g"), *[missing_safe(df, c).cast("double").alias(c)
                                                          for c in cols])
    q = quantiles(sub, cols, [0.25, 0.5, 0.75], by="_g", groups=keep)
    aggs = []
    for i, c in enumerate(cols):
        lo_map, hi_map = [], []
        for g in keep:
            q1, q3 = q[(g, c, 0.25)], q[(g, c, 0.75)]
            if q1 is not None:
                lo_map += [F.lit(g), F.lit(q1 - 1.5 * (q3 - q1))]
                hi_map += [F.lit(g), F.lit(q3 + 1.5 * (q3 - q1))]
        if not lo_map:
            continue
        lo, hi = F.create_map(*lo_map)[F.col("_g")], F.create_map(*hi_map)[F.col("_g")]
        x = F.col(quote(c))
        aggs += [F.count(x).alias(f"n{i}"), F.min(F.when(x >= lo, x)).alias(f"wl{i}"),
                 F.max(F.when(x <= hi, x)).alias(f"wh{i}"), F.count_if((x < lo) | (x > hi)).alias(f"f{i}")]
    if not aggs:
        return spark.createDataFrame([], ddl)
    rows = []
    for r in sub.groupBy("_g").agg(*aggs).collect():      # one row per kept category (≤ 15)
        g = r["_g"]
        for i, c in enumerate(cols):
            if q[(g, c, 0.25)] is None or f"n{i}" not in r.asDict():
                continue
            rows.append((c, str(g), r[f"n{i}"], q[(g, c, 0.25)], q[(g, c, 0.5)], q[(g, c, 0.75)],
                         r[f"wl{i}"], r[f"wh{i}"], r[f"f{i}"]))
    return spark.createDataFrame(rows, ddl)
