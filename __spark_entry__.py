"""

``entry(spark)`` runs the flagship query (the data-quality audit of ``events``)
``(spark, sf_dir)`` and reads the bundled Parquet tables (whole tables, no row
caps). ``oracle_sql()`` gives the equivalent DuckDB SQL on the same tables;
computed doubles are rounded to 6 decimals on both sides because summation
order differs between engines. Dirty inputs are derived by the same
expressions on both sides (FIXTURES.md F2–F4).
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tabscope.functions.stats import quantiles as _quantiles  # noqa: E402
from tabscope.functions.typeclass import select_by_type  # noqa: E402
from tabscope.operators import (chartdata, detect, iforest, outliers, profile,  # noqa: E402
                                relations, segment, timeseries, transform)
from tabscope.plans import audit, eda, reports  # noqa: E402
from tabscope.sources import readers  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round computed doubles to 6 decimals (summation order differs by engine)."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- fixtures (FIXTURES.md)

def f2(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_quantity")).alias("qty"),
                     F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("flag"))


def f3(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")


def f4(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 7 == 0, F.concat(F.lit("  "), F.col("o_orderpriority")))
        .when(k % 5 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("pri"),
        F.when(k % 11 == 0, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date_text"),
        F.when(k % 13 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")).alias("cust_text"))


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    """customer with the balance named as a non-negative measure (for D5)."""
    return _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("account_amount"),
                                            "c_nationkey")


def zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ in the sign of zero or in the kind of missing value only, wide and narrow columns mixed."""
    odd = F.col("l_orderkey") % 2 == 1
    return _t(spark, sf, "lineitem").select(
        F.when(odd, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("z"),
        F.when(odd, F.lit(float("nan"))).otherwise(F.lit(None)).alias("gap"),
        "l_returnflag", "l_linestatus", "l_linenumber",
        F.repeat("l_returnflag", 100).alias("note"))


def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that look like numbers: with a letter, infinite, spaced, with an exponent, or not at all."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    return _t(spark, sf, "orders").select("o_orderkey", F.when(k == 0, F.concat(c, F.lit("d"))).when(
        k == 1, "inf").when(k == 2, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 3, "1.25e3").otherwise(
        F.concat(c, F.lit("F"))).alias("amount"))


def long_tail(spark: SparkSession, sf: str) -> DataFrame:
    """events.value between 0 and 1 with a few values far out."""
    return _t(spark, sf, "events").select(F.when(F.col("event_id") % 1000 == 0, F.lit(1000.0)).otherwise(
        F.col("value") - F.floor("value")).alias("value"))


def f4_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderdate", F.when(
        F.col("o_orderkey") % 6 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A date-named text column that does not parse throughout, and a text column of dates under another name."""
    return f4(spark, sf).select("o_orderkey", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col(
        "o_orderkey").cast("int") % 300), "yyyy-MM-dd").alias("made_on"), "order_date_text", "pri")


TEXT_DATES = ("(SELECT o_orderkey, strftime(DATE '2024-01-01' + CAST(o_orderkey % 300 AS INTEGER), '%Y-%m-%d') AS made_on, "
              "order_date_text, pri FROM {F4})")
ZEROS = ("(SELECT 0.0::DOUBLE AS z, CAST(NULL AS DOUBLE) AS gap, l_returnflag, l_linestatus, l_linenumber, "
         "repeat(l_returnflag, 100) AS note FROM lineitem)")
NUMBER_TEXTS = "(SELECT o_orderkey, o_custkey, o_orderkey % 5 AS k FROM orders)"
LONG_TAIL = "(SELECT CASE WHEN event_id % 1000 = 0 THEN 1000.0 ELSE value - floor(value) END AS value FROM events)"
F2 = ("(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty, "
      "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)")
F3 = "(SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem)"
F4 = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderpriority "
      "WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS pri, "
      "CASE WHEN o_orderkey % 11 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END "
      "AS order_date_text, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END "
      "AS cust_text FROM orders)")
AMOUNTS = "(SELECT c_custkey, c_acctbal AS account_amount, c_nationkey FROM customer)"


# ---------------------------------------------------------------- scans written from the tables

def _csv_source(spark: SparkSession, sf: str) -> str:
    """Write an F4-derived CSV (with NA tokens) to the shared scratch folder."""
    from tabscope.session import scratch_path
    k = F.col("o_orderkey")
    d = f4(spark, sf).join(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    out = d.select(
        "o_orderkey",
        F.when(k % 17 == 0, F.lit("N/A")).otherwise(F.col("pri")).alias("pri"),
        F.when(k % 19 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 23 == 0, F.lit("null")).otherwise(F.col("cust_text")).alias("cust_text"),
        F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("active"))
    path = scratch_path(spark, "csv")
    (out.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def q_scan_csv(spark, sf):
    return readers.scan_csv(spark, _csv_source(spark, sf))


def q_scan_json(spark, sf):
    from tabscope.session import scratch_path
    path = scratch_path(spark, "json")
    f2(spark, sf).write.json(path)
    return readers.scan_json(spark, path)


def q_read_table(spark, sf):
    return readers.read_table(spark, f"{sf.rstrip('/')}/nation.parquet")


# ---------------------------------------------------------------- query registry

def _ts_daily(spark, sf, table, tcol, vcol):
    return timeseries.daily_resample(_t(spark, sf, table), tcol, vcol)


_EDA_DOUBLES = {"bin_start", "bin_end", "pct", "q1", "median", "q3", "whisker_low", "whisker_high", "event_id",
                "user_id", "value", "slope", "intercept", "r2"}


def _eda_part(part: str):
    """One chart-data table of the exploratory analysis of events."""
    def query(spark, sf):
        out = eda.eda_report(_t(spark, sf, "events"))[part]
        return _r6(out, *[c for c, t in out.dtypes if c in _EDA_DOUBLES and t == "double"])
    return query


def q_one_click_parts(spark, sf):
    """Tables of the one-click report: their rows and the sum of their counts (values: ``one_click_values``)."""
    rep = reports.one_click_report(_t(spark, sf, "events"))
    out = None
    tables = [(n, rep["eda"][n], "n" if n == "box_by_category" else "count") for n in (
        "histograms", "bars", "pies", "scatter", "box_by_category")]
    tables += [(n, rep["eda"][n], None) for n in ("group_means", "trends")]
    tables += [(n, rep["time"][n], None) for n in ("decomposition", "monthly", "weekday")]
    for name, df, col in tables:
        total = F.sum(col).cast("bigint") if col else F.lit(None).cast("bigint")
        part = df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), total.alias("total"))
        out = part if out is None else out.unionAll(part)
    return out


#: Value columns of the one-click report's tables.
ONE_CLICK_VALUES = {
    "histograms": ["bin_start", "bin_end", "count"], "bars": ["count"], "pies": ["count", "pct"], "scatter": ["count"],
    "facets": ["count"], "box_by_category": ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers"],
    "group_means": ["event_id", "user_id", "value"], "trends": ["slope", "intercept", "r2", "n"],
    "decomposition": ["observed", "trend", "seasonal", "resid"], "monthly": ["mean"], "weekday": ["mean"]}


def q_one_click_values(spark, sf):
    """The sum of every value column of the one-click report's tables, so that each is computed."""
    rep = reports.one_click_report(_t(spark, sf, "events"))
    out = None
    for name, cols in ONE_CLICK_VALUES.items():
        df = rep["time" if name in ("decomposition", "monthly", "weekday") else "eda"][name]
        sums = df.agg(*[F.round(F.sum(F.round(F.col(c).cast("double"), 6)), 6).alias(c) for c in cols])
        part = sums.unpivot([], cols, "column_name", "total").select(F.lit(name).alias("part"), "column_name", "total")
        out = part if out is None else out.unionAll(part)
    return out


def q_outlier_flag_all(spark, sf):
    """The combined flag of all three methods covers every row that IQR or z-score flags, and every forest row."""
    from tabscope.operators.iforest import isolation_forest_flags
    ev = _t(spark, sf, "events").select("event_id", "value")
    two = outliers.outlier_flag(ev, "value", iforest=False, flag_col="two")
    three = outliers.outlier_flag(ev, "value", iforest=True, flag_col="three").select("event_id", "three")
    forest = isolation_forest_flags(ev, "value").select("event_id", "is_iforest")
    both = two.join(three, "event_id").join(forest, "event_id")
    expect = F.when((F.col("two") == "Outlier") | F.col("is_iforest"), "Outlier").otherwise("Normal")
    return both.agg(F.count("*").alias("rows"), F.bool_and(F.col("three") == expect).alias("is_the_union"))


def _expected_outliers(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``expected``: IQR or z-score or isolation forest, each flag from its own function."""
    x = F.col(col).cast("double")
    b, z = outliers.iqr_bounds(df, [col])[col], outliers.zscore_stats(df, [col])[col]
    two = outliers.iqr_predicate(x, b) | outliers.zscore_predicate(x, z)
    return iforest.isolation_forest_flags(df, col).withColumn("expected", two | F.col("is_iforest"))


def q_outlier_flag_forest(spark, sf):
    """Every row of the three-method flag, held against the three tests made one by one."""
    ev = _t(spark, sf, "events").select("event_id", "value")
    flag = outliers.outlier_flag(ev, "value")
    both = flag.join(_expected_outliers(ev, "value").select("event_id", "expected"), "event_id")
    return both.select("event_id", "value", ((F.col("is_outlier") == "Outlier") == F.col("expected")).alias("agrees"))


def q_outliers_combined_forest(spark, sf):
    """Every distinct value: it is in the three-method list exactly when one of the three tests flags it."""
    ev = _t(spark, sf, "events").select("value")
    listed = outliers.outliers_combined(ev, "value").withColumn("listed", F.lit(True))
    values = _expected_outliers(ev, "value").filter("value is not null").groupBy("value").agg(
        F.bool_or("expected").alias("expected"))
    return values.join(listed, "value", "full").select(
        "value", (F.coalesce("listed", F.lit(False)) == F.col("expected")).alias("agrees"))


def _expected_compare(spark, sf):
    """The three-method comparison of events, beside means and deviations by the three tests made one by one."""
    ev = _t(spark, sf, "events")
    found = outliers.outlier_compare(ev, "value")
    rows = _expected_outliers(ev, "value").select("expected", F.explode(F.create_map(*[
        x for c in ("event_id", "user_id") for x in (F.lit(c), F.col(c).cast("double"))])).alias("column_name", "x"))
    means = rows.groupBy("column_name").agg(
        F.avg(F.when(F.col("expected"), F.col("x"))).alias("om"), F.avg(F.when(~F.col("expected"), F.col("x"))).alias("nm"),
        F.stddev_samp(F.when(~F.col("expected"), F.col("x"))).alias("ns"))
    return found, means


def q_outlier_compare_forest(spark, sf):
    found, means = _expected_compare(spark, sf)
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * (F.abs(F.col(b)) + 1)
    distinct = F.abs(F.col("om") - F.col("nm")) > 1.5 * F.col("ns")
    return means.join(found, "column_name", "left").select("column_name", (
        close("outlier_mean", "om") & close("normal_mean", "nm") & close("normal_std", "ns")
        & (F.col("is_distinct") == distinct)).alias("agrees"))


def q_outlier_verdict_forest(spark, sf):
    found, means = _expected_compare(spark, sf)
    distinct = means.agg(F.count_if(F.abs(F.col("om") - F.col("nm")) > 1.5 * F.col("ns")).alias("d"))
    verdict = F.when(F.col("d") > 0, "behavioural").otherwise("statistical")
    return outliers.outlier_verdict(found).crossJoin(distinct).select(
        ((F.col("verdict") == verdict) & (F.col("distinct_columns") == F.col("d"))).alias("agrees"))


def q_column_report_forest(spark, sf):
    """The report's outlier counts with the forest; the combined one against the three tests made one by one."""
    ev = _t(spark, sf, "events").select("value")
    values = _expected_outliers(ev, "value").agg(F.count_distinct(F.when(F.col("expected"), F.col("value"))).alias("n"))
    return reports.column_report(ev, "value").crossJoin(values).select(
        "column_name", "iqr_outliers", "z_outliers", (F.col("combined_outliers") == F.col("n")).alias("agrees"))


def q_kde_close(spark, sf):
    """The binned curve against the exact sum on a long-tailed column."""
    df = long_tail(spark, sf)
    exact = chartdata.kde_curve(df, "value", grid=50, exact=True).select("point", F.col("density").alias("e"))
    both = chartdata.kde_curve(df, "value", grid=50).join(exact, "point")
    return both.agg((F.max(F.abs(F.col("density") - F.col("e"))) <= 1e-4 * F.max("e")).alias("within_1e4_of_the_peak"),
                    F.count("*").alias("points"))


def q_scatter_spread(spark, sf):
    """Share of each band of l_quantity in a sample of repeated points against its share of the rows."""
    def shares(df, name):
        band = F.floor((F.col("l_quantity") - 1) / 10)
        total = df.count()
        return df.groupBy(band.alias("band")).agg((F.count("*") / F.lit(total)).alias(name))
    rows = _t(spark, sf, "lineitem").select("l_quantity", "l_discount")
    sample = chartdata.scatter_sample(rows, ["l_quantity", "l_discount"], 1000)
    return shares(rows, "p").join(shares(sample, "s"), "band", "left").select(
        "band", (F.abs(F.coalesce("s", F.lit(0.0)) - F.col("p")) < 0.06).alias("close"))


def q_iforest_extreme(spark, sf):
    """Repeated values 1..50 of l_quantity with a few rows at 5000: the extreme has the highest score."""
    rows = _t(spark, sf, "lineitem").select(F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(500)) == 0,
                                                   F.lit(5000.0)).otherwise(F.col("l_quantity")).alias("v"))
    s = iforest.isolation_forest_scores(rows, "v")
    far = F.col("v") == 5000.0
    score = F.col("iforest_score")
    return s.agg((F.min(F.when(far, score)) > F.max(F.when(~far, score))).alias("extreme_scores_highest"),
                 F.bool_and(F.when(far, F.col("is_iforest"))).alias("extremes_flagged"))


def blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities with blanks that only Unicode knows at one end (F4 with other blanks)."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    ends = [(7, "\u00a0", ""), (5, "", "\u3000"), (3, "\x1c", "\u2029"), (2, "\u200b", "")]     # the last is no blank
    pri = p
    for mod, before, after in reversed(ends):
        pri = F.when(k % mod == 0, F.concat(F.lit(before), p, F.lit(after))).otherwise(pri)
    return _t(spark, sf, "orders").select("o_orderkey", pri.alias("pri"))


def with_infinities(spark: SparkSession, sf: str) -> DataFrame:
    """events with an infinite value in every tenth row, of either sign."""
    k = F.col("event_id")
    return _t(spark, sf, "events").select("event_id", "event_type", F.when(k % 20 == 0, F.lit(float("inf"))).when(
        k % 20 == 10, F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"))


WIDE_COLUMNS = 24


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """24 numeric columns of lineitem rows, some with missing values, one constant."""
    li = _t(spark, sf, "lineitem")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    cols = []
    for i in range(WIDE_COLUMNS - 1):
        x = F.col(base[i % 4]).cast("double") * (i + 1) + F.col(base[(i // 4) % 4]).cast("double")
        cols.append((F.when(F.col("l_orderkey") % (i + 2) == 0, F.lit(None)).otherwise(x) if i % 3 == 0 else x).alias(f"c{i}"))
    return li.select(*cols, F.lit(7.5).alias(f"c{WIDE_COLUMNS - 1}"))


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    # sources
    q["scan_csv"] = q_scan_csv
    q["scan_json"] = q_scan_json
    q["read_table"] = q_read_table
    q["table_shape"] = lambda s, d: readers.table_shape(_t(s, d, "lineitem"))
    q["schema_table"] = lambda s, d: readers.schema_table(s, _t(s, d, "lineitem"))
    q["preview_head"] = lambda s, d: readers.preview_head(_t(s, d, "orders"), 5, ["o_orderkey"])

    # column transforms
    q["select_numeric"] = lambda s, d: select_by_type(_t(s, d, "lineitem"), "numeric")
    q["drop_columns"] = lambda s, d: transform.drop_columns(_t(s, d, "orders"),
                                                            ["o_orderpriority", "o_orderstatus"])
    q["cast_numeric"] = lambda s, d: transform.convert_type(
        f4(s, d).select("o_orderkey", "cust_text"), "cust_text", "numeric")
    q["cast_numeric_texts"] = lambda s, d: transform.convert_type(number_texts(s, d), "amount", "numeric")
    q["cast_int"] = lambda s, d: transform.convert_type(number_texts(s, d), "amount", "int")
    q["cast_datetime"] = lambda s, d: transform.convert_type(
        f4(s, d).select("o_orderkey", "order_date_text"), "order_date_text", "datetime")
    q["cast_string"] = lambda s, d: transform.convert_type(
        _t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "string")
    q["conversion_report"] = lambda s, d: transform.conversion_report(f4(s, d), "cust_text", "numeric")
    q["category_codes"] = lambda s, d: transform.category_codes(f2(s, d), "flag")
    q["standardize_categories"] = lambda s, d: transform.standardize_categories(
        f4(s, d).select("o_orderkey", "pri"), "pri", ["1-URGENT", "1-urgent", "  1-URGENT"], "URGENT")
    q["derive_arith"] = lambda s, d: transform.derive_numeric(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"),
        "l_extendedprice", "*", "l_discount", "discount_value")
    q["derive_ratio"] = lambda s, d: transform.derive_numeric(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"),
        "l_extendedprice", "/", "l_quantity", "unit_price")

    def q_datetime_parts(s, d):
        out = transform.datetime_parts(_t(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
        return out.select(*[F.col(c).cast("bigint").alias(c)
                            if c not in ("o_orderdate", "o_orderdate_day_name") else F.col(c)
                            for c in out.columns])
    q["datetime_parts"] = q_datetime_parts
    q["bin_equal_width"] = lambda s, d: transform.bin_equal_width(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5, "qty_bin")
    q["impute_mean"] = lambda s, d: _r6(transform.handle_missing(f2(s, d), "qty", "mean"), "qty")
    q["impute_median"] = lambda s, d: transform.handle_missing(f2(s, d), "qty", "median")
    q["impute_mode"] = lambda s, d: transform.handle_missing(f2(s, d), "flag", "mode")
    q["fill_constant"] = lambda s, d: transform.handle_missing(f2(s, d), "qty", "constant", 0)
    q["drop_missing"] = lambda s, d: transform.handle_missing(f2(s, d), "qty", "drop")
    q["scale_standard"] = lambda s, d: _r6(transform.scale(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"),
        ["l_extendedprice", "l_quantity"], "standard"), "l_extendedprice", "l_quantity")
    q["scale_minmax"] = lambda s, d: _r6(transform.scale(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"),
        ["l_extendedprice", "l_quantity"], "minmax"), "l_extendedprice", "l_quantity")
    q["collapse_rare"] = lambda s, d: transform.collapse_rare(
        _t(s, d, "part").select("p_partkey", "p_brand"), "p_brand", 10)
    q["outlier_flag"] = lambda s, d: outliers.outlier_flag(
        _t(s, d, "events").select("event_id", "value"), "value", iforest=False)
    q["outlier_flag_forest"] = q_outlier_flag_forest

    # filters / predicates
    q["outliers_iqr"] = lambda s, d: outliers.outliers_iqr(_t(s, d, "events"), "value")
    q["outliers_iqr_counts"] = lambda s, d: _r6(outliers.outliers_iqr_counts(_t(s, d, "events")),
                                                "q1", "q3", "lower", "upper")
    q["outliers_zscore"] = lambda s, d: outliers.outliers_zscore(_t(s, d, "events"), "value")
    q["outliers_iforest"] = lambda s, d: iforest.outliers_iforest(_t(s, d, "events"), "value")
    q["outliers_combined"] = lambda s, d: outliers.outliers_combined(_t(s, d, "events"), "value", iforest=False)
    q["outliers_combined_forest"] = q_outliers_combined_forest
    q["negative_values"] = lambda s, d: outliers.negative_values(amounts(s, d))
    q["whitespace_issues"] = lambda s, d: outliers.whitespace_issues(f4(s, d))
    q["duplicate_rows"] = lambda s, d: profile.duplicate_rows(f3(s, d))
    q["filter_top_categories"] = lambda s, d: transform.filter_top_categories(
        _t(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", 15)
    q["columns_with_missing"] = lambda s, d: profile.columns_with_missing(f2(s, d))

    # aggregations
    q["missing_summary"] = lambda s, d: _r6(profile.missing_summary(f2(s, d)), "missing_pct")
    q["missing_patterns"] = lambda s, d: profile.missing_patterns(f2(s, d))
    q["missing_bands"] = lambda s, d: _r6(profile.missing_bands(f2(s, d), "l_orderkey", 10), "missing_rate")
    q["missing_bands_time"] = lambda s, d: _r6(profile.missing_bands(
        f4_dates(s, d), "o_orderdate", 4), "missing_rate")
    q["duplicate_count"] = lambda s, d: profile.duplicate_count(f3(s, d))
    q["drop_duplicates"] = lambda s, d: profile.drop_duplicates(f3(s, d))
    q["duplicate_count_zeros"] = lambda s, d: profile.duplicate_count(zeros(s, d))
    q["drop_duplicates_zeros"] = lambda s, d: profile.drop_duplicates(zeros(s, d))
    q["duplicate_ids"] = lambda s, d: profile.duplicate_ids(_t(s, d, "events"), "user_id")
    q["distinct_counts"] = lambda s, d: profile.distinct_counts(_t(s, d, "orders"))
    q["value_counts"] = lambda s, d: profile.value_counts(_t(s, d, "events"), "event_type")
    q["topn_other"] = lambda s, d: profile.topn_other(_t(s, d, "part"), "p_brand", 20)
    q["pie_shares"] = lambda s, d: _r6(profile.pie_shares(_t(s, d, "part"), "p_brand", 10), "pct")
    q["top_category"] = lambda s, d: profile.top_category(_t(s, d, "orders"), "o_orderpriority")
    q["table_summary"] = lambda s, d: _r6(profile.table_summary(_t(s, d, "events")), "mean", "std",
                                          "missing_pct")
    q["numeric_report"] = lambda s, d: _r6(profile.numeric_report(_t(s, d, "orders"), "o_totalprice"),
                                           "mean", "median", "std", "min", "max")
    q["numeric_summary_all"] = lambda s, d: _r6(profile.numeric_summary_all(_t(s, d, "lineitem")),
                                                "mean", "median", "min", "max")
    q["skew_kurt"] = lambda s, d: _r6(profile.skew_kurt(_t(s, d, "orders")), "skewness", "kurtosis")
    q["skew_label"] = lambda s, d: profile.skew_kurt(_t(s, d, "events")).select("column_name", "skew_label")
    q["normality_test"] = lambda s, d: _r6(profile.normality_test(_t(s, d, "events")), "statistic", "p_value")
    q["quantiles"] = q_quantiles
    q["box_stats"] = lambda s, d: _r6(chartdata.box_stats(_t(s, d, "lineitem"), "l_extendedprice"),
                                      "q1", "median", "q3")
    q["box_stats_by_category"] = lambda s, d: _r6(
        chartdata.box_stats_by_category(_t(s, d, "events"), "event_type", "value"), "q1", "median", "q3")
    q["histogram"] = lambda s, d: _r6(chartdata.histogram(_t(s, d, "events"), "value"), "bin_start", "bin_end")
    q["kde_curve"] = lambda s, d: _r6(chartdata.kde_curve(_t(s, d, "events"), "value"),
                                      "x", "density", "count_density")
    q["kde_exact"] = lambda s, d: _r6(chartdata.kde_curve(long_tail(s, d), "value", grid=50, exact=True),
                                      "x", "density").select("point", "x", "density")
    q["kde_close_to_exact"] = q_kde_close
    q["corr_matrix"] = lambda s, d: _r6(relations.corr_matrix(_t(s, d, "lineitem")), "r")
    q["top_corr_pairs"] = lambda s, d: _r6(relations.top_corr_pairs(_t(s, d, "lineitem")), "r", "abs_r")
    q["distinct_counts_approx"] = lambda s, d: profile.distinct_counts(
        _t(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"], approx=True)
    q["corr_matrix_wide"] = lambda s, d: _r6(relations.corr_matrix(wide(s, d)), "r")
    q["whitespace_blanks"] = lambda s, d: outliers.whitespace_issues(blanks(s, d))
    q["histogram_infinite"] = lambda s, d: _r6(chartdata.histogram(with_infinities(s, d), "value"), "bin_start", "bin_end")
    q["outliers_iqr_infinite"] = lambda s, d: outliers.outliers_iqr(with_infinities(s, d), "value")
    q["iforest_infinite"] = lambda s, d: iforest.isolation_forest_flags(with_infinities(s, d), "value").filter(
        F.abs("value") == float("inf")).select("event_id", "is_iforest")
    q["outlier_flag_names"] = lambda s, d: outliers.outlier_flag(_t(s, d, "events").select(
        "event_id", F.col("value").alias("is_any"), F.col("user_id").alias("iforest_score"),
        F.col("user_id").alias("row"), F.col("user_id").alias("x")), "is_any", iforest=False)
    q["category_codes_names"] = lambda s, d: transform.category_codes(_t(s, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("_v"), F.col("o_orderstatus").alias("_code"),
        F.col("o_custkey").alias("row")), "_v")
    q["ols_trend"] = lambda s, d: _r6(relations.ols_trend(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
                                      "slope", "intercept", "r2")
    q["group_means"] = lambda s, d: _r6(relations.group_means(_t(s, d, "events"), "event_type"),
                                        "event_id", "user_id", "value")
    q["outlier_compare"] = lambda s, d: _r6(outliers.outlier_compare(_t(s, d, "events"), "value", iforest=False),
                                            "outlier_mean", "normal_mean", "normal_std")
    q["outlier_compare_forest"] = q_outlier_compare_forest
    q["case_collisions"] = lambda s, d: profile.case_collisions(f4(s, d), "pri")
    q["cardinality_class"] = lambda s, d: profile.cardinality_class(_t(s, d, "part"))
    q["time_span"] = lambda s, d: profile.time_span(_t(s, d, "orders"), "o_orderdate")
    q["granularity"] = lambda s, d: profile.granularity(_t(s, d, "orders"), "o_custkey")
    q["density_2d"] = lambda s, d: chartdata.density_2d(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice")
    q["entity_totals"] = lambda s, d: _r6(segment.entity_totals(_t(s, d, "orders"), "o_custkey",
                                                                "o_totalprice"), "total")

    # windows / segmentation
    q["pareto_segments"] = lambda s, d: _r6(segment.pareto_segments(_t(s, d, "orders"), "o_custkey",
                                                                    "o_totalprice"),
                                            "total", "cumulative_pct").withColumn(
        "cumulative_value", F.round("cumulative_value", 2))
    q["segmentation"] = lambda s, d: _r6(segment.segmentation_report(_t(s, d, "events")),
                                         "pct_entities", "value", "pct_value")
    q["pareto_summary"] = lambda s, d: _r6(segment.pareto_summary(_t(s, d, "orders"), "o_custkey",
                                                                  "o_totalprice"),
                                           "pct_entities", "value", "pct_value")
    q["pareto_split"] = lambda s, d: segment.pareto_split(_t(s, d, "orders"), "o_custkey", "o_totalprice").select(
        "segment", "entities", F.round("pct_entities", 6).alias("pct_entities"), F.round("value", 2).alias("value"),
        F.round("pct_value", 6).alias("pct_value"))

    # sorts / limits / set operations
    q["scatter_sample_by"] = lambda s, d: chartdata.scatter_sample(
        _t(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], by="l_returnflag", per_group=200)
    q["scatter_sample"] = lambda s, d: chartdata.scatter_sample(_t(s, d, "lineitem"),
                                                                ["l_quantity", "l_extendedprice"], 1000)
    q["scatter_sample_spread"] = q_scatter_spread
    q["iforest_extreme"] = q_iforest_extreme
    q["distinct_values"] = lambda s, d: chartdata.distinct_values(_t(s, d, "orders"), "o_orderpriority")

    # detectors
    q["detect_id_column"] = lambda s, d: _r6(detect.detect_id_column(_t(s, d, "orders")), "ratio")
    q["detect_entity_column"] = lambda s, d: _r6(detect.detect_entity_column(_t(s, d, "events")), "ratio")
    q["detect_value_column"] = lambda s, d: detect.detect_value_column(_t(s, d, "events"))
    q["detect_time_column"] = lambda s, d: detect.detect_time_column(_t(s, d, "orders"))
    q["detect_ts_columns"] = lambda s, d: detect.detect_ts_columns(_t(s, d, "events"))
    q["detect_category_column"] = lambda s, d: detect.detect_category_column(_t(s, d, "events"))
    q["detect_facet_column"] = lambda s, d: detect.detect_category_column(_t(s, d, "part"), 2, 10)
    q["detect_boxplot_column"] = lambda s, d: detect.detect_category_column(_t(s, d, "documents"), 0, 14,
                                                                             fallback=False)
    q["datetime_candidates"] = lambda s, d: detect.datetime_candidates(f4(s, d))
    q["invalid_dates"] = lambda s, d: detect.invalid_dates(f4(s, d))

    # time series
    q["time_analysis"] = lambda s, d: _r6(reports.time_series_daily(_t(s, d, "events")), "raw_mean", "observed")
    q["daily_resample"] = lambda s, d: _r6(_ts_daily(s, d, "orders", "o_orderdate", "o_totalprice"),
                                           "raw_mean", "observed")
    q["time_line"] = lambda s, d: _r6(timeseries.time_line(_t(s, d, "events"), "ts", "value", "hour"), "mean")
    q["seasonal_decompose"] = lambda s, d: _r6(timeseries.seasonal_decompose(
        _ts_daily(s, d, "events", "ts", "value")), "observed", "trend", "seasonal", "resid")
    q["monthly_pattern"] = lambda s, d: _r6(timeseries.monthly_pattern(
        _ts_daily(s, d, "orders", "o_orderdate", "o_totalprice")), "mean")
    q["weekday_pattern"] = lambda s, d: _r6(timeseries.weekday_pattern(
        _ts_daily(s, d, "events", "ts", "value")), "mean")

    # composite reports
    q["audit_report"] = lambda s, d: audit.audit_report(_t(s, d, "events"))
    q["insights_report"] = lambda s, d: reports.insights_report(_t(s, d, "orders"))
    q["cleaning_suggestions"] = lambda s, d: reports.cleaning_suggestions(f2(s, d))
    q["column_report"] = lambda s, d: _r6(reports.column_report(_t(s, d, "events"), "value", iforest=False),
                                          "mean", "median", "std", "min", "max", "skewness",
                                          "kurtosis", "p_value")
    q["column_report_forest"] = q_column_report_forest
    q["audit_report_documents"] = lambda s, d: audit.audit_report(_t(s, d, "documents"))
    q["table_summary_documents"] = lambda s, d: _r6(profile.table_summary(_t(s, d, "documents")),
                                                    "mean", "std", "missing_pct")
    q["duplicate_count_texts"] = lambda s, d: profile.duplicate_count(
        _t(s, d, "documents").select("text", "lang"))
    q["cardinality_documents"] = lambda s, d: profile.cardinality_class(_t(s, d, "documents"))
    for part in ("histograms", "bars", "pies", "box_by_category", "group_means", "scatter", "trends", "facets"):
        q[f"eda_{part}"] = _eda_part(part)
    q["eda_report_documents"] = lambda s, d: _r6(reports.eda_findings(_t(s, d, "documents")), "metric")
    q["eda_bars_documents"] = lambda s, d: reports.eda_report(_t(s, d, "documents"))["bars"]
    q["one_click_documents"] = lambda s, d: _r6(reports.one_click_findings(_t(s, d, "documents")).filter(
        F.col("section").isin("missing", "duplicates", "invalid", "consistency", "eda")), "metric")
    q["one_click_parts"] = q_one_click_parts
    q["one_click_values"] = q_one_click_values
    q["outlier_verdict"] = lambda s, d: outliers.outlier_verdict(outliers.outlier_compare(
        _t(s, d, "events"), "value", iforest=False))
    q["outlier_verdict_forest"] = q_outlier_verdict_forest
    q["outlier_flag_all"] = q_outlier_flag_all
    q["moderate_values"] = lambda s, d: profile.moderate_values(_t(s, d, "part"))
    q["density_3d"] = lambda s, d: chartdata.density_3d(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax")
    q["pair_plot"] = lambda s, d: chartdata.pair_plot(_t(s, d, "events"))
    q["datetime_candidates_parse"] = lambda s, d: detect.datetime_candidates(text_dates(s, d))
    q["detect_time_column_text"] = lambda s, d: detect.detect_time_column(text_dates(s, d)).select("column_name")
    q["eda_report"] = lambda s, d: reports.eda_findings(_t(s, d, "events"))
    q["one_click_report"] = lambda s, d: reports.one_click_findings(_t(s, d, "events"))
    return q


def q_quantiles(spark, sf):
    ev = _t(spark, sf, "events")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    res = _quantiles(ev, ["value", "event_id"], probs)
    rows = [(c, p, res[(None, c, p)]) for c in ["value", "event_id"] for p in probs]
    return _r6(spark.createDataFrame(rows, "column_name string, p double, value double"), "value")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the data-quality audit (findings table) of ``events`` at sf0.001."""
    return audit.audit_report(_t(spark, SMOKE_DIR, "events"))


def _optional(name: str):
    """A module that needs the corpus subpackage, or None where that (or the module itself) is not installed."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as e:
        if e.name == name or f"{e.name}.".startswith("tabscope.llm."):
            return None
        raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = _queries()
    if registry := _optional("tabscope.llm.queries"):
        out |= registry.queries()
    if pipeline := _optional("corpus_pipeline"):
        out["pipeline"] = pipeline.run
    return out


# ---------------------------------------------------------------- oracle SQL (DuckDB)

def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _iqr_counts_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, "
            f"ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper, "
            f"(SELECT COUNT(*) FROM {table} WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) "
            f"AS outliers FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})")
    return _union(parts)


def _bounds(table: str, col: str) -> str:
    return (f"(SELECT quantile_cont({col}, 0.25) - 1.5 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS lo, "
            f"quantile_cont({col}, 0.75) + 1.5 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS hi, "
            f"avg({col}) AS mu, stddev_pop({col}) AS sd FROM {table})")


def _flag_sql(col: str) -> str:
    return (f"(({col} < b.lo OR {col} > b.hi) OR "
            f"(b.sd > 0 AND abs(({col} - b.mu) / b.sd) > 3))")


def _lineitem_numeric() -> list[str]:
    return ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


# what Python's str.strip() removes, by Python's own rule
PYTHON_BLANKS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())

EVENT_NUMBERS = ["event_id", "user_id", "value"]


def _bin_sql(c: str, bins: int = 30) -> str:
    """0-based equal-width bin of an events column, its range in ``r``."""
    return f"CAST(LEAST(FLOOR(({c} - lo_{c}) * ({bins} / (hi_{c} - lo_{c}))), {bins - 1}) AS INTEGER)"


def _ranges_sql(cols: list[str]) -> str:
    return "(SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}"
                                  for c in cols) + " FROM events) r"


def _pair_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS col_x, '{b}' AS col_y, {_bin_sql(a)} AS bin_x, {_bin_sql(b)} AS bin_y, COUNT(*) AS count "
            f"FROM events, {_ranges_sql(list(dict.fromkeys([a, b])))} WHERE {a} IS NOT NULL AND {b} IS NOT NULL "
            "GROUP BY 3, 4")


def _eda_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["eda_histograms"] = _union([
        f"SELECT '{c}' AS column_name, CAST(g.i AS INTEGER) AS bin, ROUND(lo_{c} + g.i * ((hi_{c} - lo_{c}) / 30), 6) AS "
        f"bin_start, ROUND(CASE WHEN g.i = 29 THEN hi_{c} ELSE lo_{c} + (g.i + 1) * ((hi_{c} - lo_{c}) / 30) END, 6) AS "
        f"bin_end, coalesce(k, 0) AS count FROM range(30) g(i) CROSS JOIN {_ranges_sql([c])} LEFT JOIN (SELECT "
        f"{_bin_sql(c)} AS bin, COUNT(*) AS k FROM events, {_ranges_sql([c])} WHERE {c} IS NOT NULL GROUP BY 1) n "
        "ON n.bin = g.i" for c in EVENT_NUMBERS])
    top = ("SELECT '{c}' AS column_name, CASE WHEN {c} IN (SELECT {c} FROM events WHERE {c} IS NOT NULL GROUP BY {c} "
           "ORDER BY COUNT(*) DESC, {c} LIMIT {n}) THEN {c} ELSE 'Other' END AS value, COUNT(*) AS count FROM events "
           "WHERE {c} IS NOT NULL GROUP BY 2")
    o["eda_bars"] = _union([top.format(c=c, n=20) for c in ("event_type", "props")])
    o["eda_pies"] = ("SELECT column_name, value, count, ROUND(count * 100.0 / sum(count) OVER (PARTITION BY column_name), 6) "
                     "AS pct, count * 100.0 / sum(count) OVER (PARTITION BY column_name) >= 1.0 AS label_shown FROM ("
                     + _union([top.format(c=c, n=10) for c in ("event_type", "props")]) + ")")
    o["eda_box_by_category"] = _union([
        f"SELECT '{c}' AS column_name, event_type AS category, COUNT({c}) AS n, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, "
        f"ROUND(q3, 6) AS q3, ROUND(CAST(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_low, "
        f"ROUND(CAST(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6) AS whisker_high, "
        f"COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS fliers FROM events JOIN "
        f"(SELECT event_type, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS "
        f"med, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM events GROUP BY 1) USING (event_type) "
        "GROUP BY event_type, q1, med, q3" for c in EVENT_NUMBERS])
    o["eda_group_means"] = ("SELECT event_type AS category, 'event_type' AS column_name, " + ", ".join(
        f"ROUND(avg({c}), 6) AS {c}" for c in EVENT_NUMBERS) + " FROM events GROUP BY 1")
    pairs = [(a, b) for i, a in enumerate(EVENT_NUMBERS) for b in EVENT_NUMBERS[i + 1:]]
    o["eda_scatter"] = _union([_pair_sql(a, b) for a, b in pairs])
    o["eda_trends"] = _union([
        f"SELECT '{a}' AS x, '{b}' AS y, ROUND(regr_slope({b}, {a}), 6) AS slope, ROUND(regr_intercept({b}, {a}), 6) AS "
        f"intercept, ROUND(regr_r2({b}, {a}), 6) AS r2, COUNT(*) AS n FROM events WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs])
    # the facets show the pair with the largest correlation
    o["eda_facets"] = (
        "SELECT f.* FROM (" + _union([
            f"SELECT event_type AS facet, {_bin_sql(a)} AS bin_x, {_bin_sql(b)} AS bin_y, COUNT(*) AS count, "
            f"'event_type' AS facet_column, '{a}' AS col_x, '{b}' AS col_y FROM events, {_ranges_sql([a, b])} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3" for a, b in pairs])
        + ") f JOIN (SELECT * FROM (" + _union([
            f"SELECT '{a}' AS col_x, '{b}' AS col_y, abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS r FROM events"
            for a, b in pairs]) + ") ORDER BY r DESC LIMIT 1) p USING (col_x, col_y)")
    count = "SELECT '{p}' AS part, COUNT(*) AS rows, CAST({t} AS BIGINT) AS total FROM ({sql})"
    daily = _daily_sql("events", "ts", "value")
    o["one_click_parts"] = _union(
        [count.format(p=p, t=f"sum({c})", sql=o[f"eda_{p}"]) for p, c in (
            ("histograms", "count"), ("bars", "count"), ("pies", "count"), ("scatter", "count"), ("box_by_category", "n"))]
        + [count.format(p=p, t="NULL", sql=o[f"eda_{p}"]) for p in ("group_means", "trends")]
        + [count.format(p="decomposition", t="NULL", sql=f"SELECT * FROM {daily}"),
           count.format(p="monthly", t="NULL", sql=f"SELECT DISTINCT month(day) AS m FROM {daily}"),
           "SELECT 'weekday' AS part, CAST(7 AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS total"])
    time = {"decomposition": _seasonal_sql(),
            "monthly": f"SELECT ROUND(avg(observed), 6) AS mean FROM {daily} GROUP BY month(day)",
            "weekday": f"SELECT ROUND(avg(observed), 6) AS mean FROM {daily} GROUP BY isodow(day)"}
    o["one_click_values"] = _union([
        f"SELECT '{p}' AS part, unnest([{', '.join(repr(c) for c in cols)}]) AS column_name, unnest(["
        + ", ".join(f"ROUND(sum(CAST({c} AS DOUBLE)), 6)" for c in cols)
        + f"]) AS total FROM ({time.get(p) or o[f'eda_{p}']})" for p, cols in ONE_CLICK_VALUES.items()])
    return o


def _corr_sql() -> str:
    cols = _lineitem_numeric()
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                e = f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
            else:
                e = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            parts.append(f"SELECT {i} AS pos_a, '{a}' AS col_a, {j} AS pos_b, '{b}' AS col_b, "
                         f"ROUND(CAST({e} AS DOUBLE), 6) AS r FROM lineitem")
    return _union(parts)


def _daily_sql(table: str, tcol: str, vcol: str) -> str:
    return (f"(WITH d AS (SELECT CAST({tcol} AS DATE) AS day, avg({vcol}) AS mean FROM {table} "
            f"WHERE {tcol} IS NOT NULL GROUP BY 1), "
            f"cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) "
            f"SELECT cal.day, d.mean AS raw_mean, last_value(d.mean IGNORE NULLS) OVER "
            f"(ORDER BY cal.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observed "
            f"FROM cal LEFT JOIN d USING (day))")


def _seasonal_sql() -> str:
    daily = _daily_sql("events", "ts", "value")
    return (f"WITH s AS (SELECT day, observed, "
            f"CASE WHEN count(observed) OVER w = 7 THEN avg(observed) OVER w END AS trend, "
            f"CAST(date_diff('day', min(day) OVER (), day) % 7 AS INTEGER) AS phase, "
            f"date_diff('day', min(day) OVER (), max(day) OVER ()) AS span "
            f"FROM {daily} WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), "
            f"b AS (SELECT *, observed - trend AS detrended FROM s WHERE span > 14), "
            f"pm AS (SELECT phase, avg(detrended) AS m FROM b GROUP BY phase), "
            f"sea AS (SELECT phase, m - avg(m) OVER () AS seasonal FROM pm) "
            f"SELECT day, ROUND(observed, 6) AS observed, ROUND(trend, 6) AS trend, "
            f"ROUND(seasonal, 6) AS seasonal, ROUND(detrended - seasonal, 6) AS resid, phase "
            f"FROM b JOIN sea USING (phase)")


def _pareto_sql() -> str:
    return ("(WITH t AS (SELECT o_custkey AS entity, coalesce(sum(o_totalprice), 0.0) AS total FROM orders "
            "WHERE o_custkey IS NOT NULL GROUP BY 1), "
            "r AS (SELECT entity, total, CAST(row_number() OVER (ORDER BY total DESC, entity) - 1 AS BIGINT) AS rank, "
            "sum(total) OVER (ORDER BY total DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            "AS cumulative_value, sum(total) OVER () AS grand FROM t) "
            "SELECT entity, total, rank, cumulative_value, "
            "CASE WHEN grand = 0 THEN 0.0 ELSE cumulative_value / grand * 100.0 END AS cumulative_pct FROM r)")


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    li_num = _lineitem_numeric()

    o["scan_csv"] = (
        "SELECT f.o_orderkey AS o_orderkey, CASE WHEN f.o_orderkey % 17 = 0 THEN NULL ELSE f.pri END AS pri, "
        "CASE WHEN f.o_orderkey % 19 = 0 THEN NULL ELSE o.o_totalprice END AS price, "
        "CASE WHEN f.o_orderkey % 23 = 0 THEN NULL ELSE f.cust_text END AS cust_text, "
        "f.o_orderkey % 2 = 0 AS active "
        f"FROM {F4} f JOIN orders o USING (o_orderkey)")
    o["scan_json"] = f"SELECT flag, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_orderkey, qty FROM {F2}"
    o["read_table"] = "SELECT * FROM nation"
    o["table_shape"] = "SELECT COUNT(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem"
    o["schema_table"] = (
        "SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name, "
        "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END "
        "AS data_type FROM information_schema.columns WHERE table_name = 'lineitem'")
    o["preview_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"

    o["select_numeric"] = f"SELECT {', '.join(li_num)} FROM lineitem"
    o["drop_columns"] = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"
    o["cast_numeric"] = f"SELECT o_orderkey, TRY_CAST(trim(cust_text) AS DOUBLE) AS cust_text FROM {F4}"
    o["cast_numeric_texts"] = (
        "SELECT o_orderkey, CASE WHEN k = 1 THEN CAST('inf' AS DOUBLE) WHEN k IN (0, 4) THEN NULL WHEN k = 3 "
        f"THEN 1250.0 ELSE CAST(o_custkey AS DOUBLE) END AS amount FROM {NUMBER_TEXTS}")
    o["cast_int"] = f"SELECT o_orderkey, CASE WHEN k = 2 THEN o_custkey END AS amount FROM {NUMBER_TEXTS}"
    o["cast_datetime"] = f"SELECT o_orderkey, TRY_CAST(order_date_text AS TIMESTAMP) AS order_date_text FROM {F4}"
    o["cast_string"] = "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders"
    o["conversion_report"] = (
        "SELECT 'cust_text' AS column_name, 'numeric' AS target, COUNT(*) FILTER "
        f"(WHERE cust_text IS NOT NULL AND TRY_CAST(trim(cust_text) AS DOUBLE) IS NULL) AS newly_missing FROM {F4}")
    o["category_codes"] = (
        f"SELECT f.*, CAST(coalesce(c.code, -1) AS BIGINT) AS flag_code FROM {F2} f LEFT JOIN "
        f"(SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS code FROM (SELECT DISTINCT flag FROM {F2} "
        "WHERE flag IS NOT NULL)) c USING (flag)")
    o["standardize_categories"] = (
        "SELECT o_orderkey, CASE WHEN pri IN ('1-URGENT', '1-urgent', '  1-URGENT') THEN 'URGENT' ELSE pri END "
        f"AS pri FROM {F4}")
    o["derive_arith"] = ("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, "
                         "l_extendedprice * l_discount AS discount_value FROM lineitem")
    o["derive_ratio"] = ("SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, "
                         "l_extendedprice / (l_quantity + 1e-9) AS unit_price FROM lineitem")
    o["datetime_parts"] = (
        "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year, "
        "CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month, CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day, "
        "CAST(quarter(o_orderdate) AS BIGINT) AS o_orderdate_quarter, "
        "CAST(isodow(o_orderdate) - 1 AS BIGINT) AS o_orderdate_day_of_week, "
        "dayname(o_orderdate) AS o_orderdate_day_name, CAST(week(o_orderdate) AS BIGINT) AS o_orderdate_week_of_year "
        "FROM orders")
    o["bin_equal_width"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity, CAST(LEAST(GREATEST(CEIL((l_quantity - mn) / ((mx - mn) / 5)) - 1, 0), 4) "
        "AS BIGINT) AS qty_bin FROM lineitem, (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem)")
    o["impute_mean"] = (f"SELECT l_orderkey, l_linenumber, ROUND(coalesce(qty, (SELECT avg(qty) FROM {F2})), 6) "
                        f"AS qty, flag FROM {F2}")
    o["impute_median"] = (f"SELECT l_orderkey, l_linenumber, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM {F2})) "
                          f"AS qty, flag FROM {F2}")
    o["impute_mode"] = (f"SELECT l_orderkey, l_linenumber, qty, coalesce(flag, (SELECT flag FROM {F2} WHERE flag "
                        f"IS NOT NULL GROUP BY flag ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag FROM {F2}")
    o["fill_constant"] = f"SELECT l_orderkey, l_linenumber, coalesce(qty, 0.0) AS qty, flag FROM {F2}"
    o["drop_missing"] = f"SELECT * FROM {F2} WHERE qty IS NOT NULL"
    o["scale_standard"] = (
        "SELECT l_orderkey, l_linenumber, ROUND((l_extendedprice - ae) / se, 6) AS l_extendedprice, "
        "ROUND((l_quantity - aq) / sq, 6) AS l_quantity FROM lineitem, (SELECT avg(l_extendedprice) AS ae, "
        "stddev_pop(l_extendedprice) AS se, avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq FROM lineitem)")
    o["scale_minmax"] = (
        "SELECT l_orderkey, l_linenumber, ROUND((l_extendedprice - ae) / (xe - ae), 6) AS l_extendedprice, "
        "ROUND((l_quantity - aq) / (xq - aq), 6) AS l_quantity FROM lineitem, (SELECT min(l_extendedprice) AS ae, "
        "max(l_extendedprice) AS xe, min(l_quantity) AS aq, max(l_quantity) AS xq FROM lineitem)")
    o["collapse_rare"] = (
        "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY COUNT(*) DESC, "
        "p_brand LIMIT 10) THEN p_brand ELSE 'Other' END AS p_brand FROM part")
    o["outlier_flag"] = (
        f"SELECT event_id, value, CASE WHEN {_flag_sql('value')} THEN 'Outlier' ELSE 'Normal' END AS is_outlier "
        f"FROM events, {_bounds('events', 'value')} b")

    o["outliers_iqr"] = f"SELECT value FROM events, {_bounds('events', 'value')} b WHERE value < b.lo OR value > b.hi"
    o["outliers_iqr_counts"] = _iqr_counts_sql("events", ["event_id", "user_id", "value"])
    o["outliers_zscore"] = (f"SELECT value FROM events, {_bounds('events', 'value')} b "
                            "WHERE b.sd > 0 AND abs((value - b.mu) / b.sd) > 3")
    o["outliers_combined"] = (f"SELECT DISTINCT value FROM events, {_bounds('events', 'value')} b "
                              f"WHERE {_flag_sql('value')} ORDER BY value")
    o["negative_values"] = (f"SELECT 'account_amount' AS column_name, COUNT(*) FILTER (WHERE account_amount < 0) "
                            f"AS negative_count FROM {AMOUNTS}")
    ws = f"trim({{c}}, '{PYTHON_BLANKS}')"
    o["whitespace_issues"] = _union([
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} <> {ws.format(c=c)}) AS affected, "
        f"min(CASE WHEN {c} <> {ws.format(c=c)} THEN {c} END) AS example FROM {F4}"
        for c in ["pri", "order_date_text", "cust_text"]])
    o["duplicate_rows"] = (
        f"SELECT f.* FROM {F3} f JOIN (SELECT l_returnflag, l_linestatus, l_linenumber FROM {F3} "
        "GROUP BY l_returnflag, l_linestatus, l_linenumber HAVING COUNT(*) > 1) g USING (l_returnflag, l_linestatus, l_linenumber) "
        "ORDER BY l_returnflag, l_linestatus, l_linenumber")
    o["filter_top_categories"] = (
        "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_brand IN (SELECT p_brand FROM part "
        "GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand LIMIT 15)")
    o["columns_with_missing"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name FROM {F2} HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0"
        for i, c in enumerate(["l_orderkey", "l_linenumber", "qty", "flag"])])

    o["missing_summary"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*), 6) AS missing_pct FROM {F2} "
        f"HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0"
        for i, c in enumerate(["l_orderkey", "l_linenumber", "qty", "flag"])])
    mask = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END"
                       for c in ["l_orderkey", "l_linenumber", "qty", "flag"])
    o["missing_patterns"] = (f"SELECT pattern, COUNT(*) AS rows, CAST(length(replace(pattern, '0', '')) AS INTEGER) "
                             f"AS missing_columns FROM (SELECT {mask} AS pattern FROM {F2}) GROUP BY pattern")
    cuts = ", ".join(f"quantile_cont(CAST(l_orderkey AS DOUBLE), {k / 10})" for k in range(1, 10))
    band = " + ".join(f"CASE WHEN l_orderkey > c[{k}] THEN 1 ELSE 0 END" for k in range(1, 10))
    o["missing_bands"] = (
        f"WITH cp AS (SELECT [{cuts}] AS c FROM {F2}), b AS (SELECT f.*, CAST({band} AS INTEGER) AS band "
        f"FROM {F2} f, cp) "
        + _union([f"SELECT band, COUNT(*) AS rows, '{c}' AS column_name, ROUND(avg(CASE WHEN {c} IS NULL "
                  f"THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM b GROUP BY band"
                  for c in ["l_linenumber", "qty", "flag"]]))
    o["missing_bands_time"] = (
        "WITH t AS (SELECT epoch_us(o_orderdate) AS o, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END "
        "AS status FROM orders), c AS (SELECT quantile_cont(o, 0.25) AS a, quantile_cont(o, 0.5) AS b, "
        "quantile_cont(o, 0.75) AS d FROM t), x AS (SELECT CAST((o > a)::INT + (o > b)::INT + (o > d)::INT AS INTEGER) "
        "AS band, status FROM t, c) SELECT band, COUNT(*) AS rows, 'status' AS column_name, "
        "ROUND(avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM x GROUP BY band")
    o["duplicate_count"] = (f"SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_rows FROM "
                            f"(SELECT COUNT(*) AS k FROM {F3} GROUP BY l_returnflag, l_linestatus, l_linenumber)")
    o["drop_duplicates"] = f"SELECT DISTINCT * FROM {F3}"
    o["duplicate_ids"] = ("SELECT 'user_id' AS column_name, CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_ids "
                          "FROM (SELECT COUNT(*) AS k FROM events GROUP BY user_id)")
    o["distinct_counts"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM orders"
        for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                               "o_orderpriority"])])
    o["value_counts"] = ("SELECT event_type AS value, COUNT(*) AS count FROM events WHERE event_type IS NOT NULL "
                         "GROUP BY 1 ORDER BY count DESC, value")
    topn = ("SELECT CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand "
            "LIMIT {n}) THEN p_brand ELSE 'Other' END AS value, COUNT(*) AS count FROM part "
            "WHERE p_brand IS NOT NULL GROUP BY 1")
    o["topn_other"] = topn.format(n=20)
    o["pie_shares"] = (f"SELECT value, count, ROUND(count * 100.0 / sum(count) OVER (), 6) AS pct, "
                       f"count * 100.0 / sum(count) OVER () >= 1.0 AS label_shown FROM ({topn.format(n=10)})")
    o["top_category"] = ("SELECT o_orderpriority AS value, COUNT(*) AS count FROM orders GROUP BY 1 "
                         "ORDER BY count DESC, value LIMIT 1")
    o["table_summary"] = _table_summary_sql()
    o["numeric_report"] = (
        "SELECT 'o_totalprice' AS column_name, ROUND(avg(o_totalprice), 6) AS mean, "
        "ROUND(quantile_cont(o_totalprice, 0.5), 6) AS median, ROUND(stddev_samp(o_totalprice), 6) AS std, "
        "ROUND(min(o_totalprice), 6) AS min, ROUND(max(o_totalprice), 6) AS max, "
        "COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS missing FROM orders")
    o["numeric_summary_all"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, ROUND(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, ROUND(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"ROUND(CAST(max({c}) AS DOUBLE), 6) AS max FROM lineitem" for i, c in enumerate(li_num)])
    label = ("CASE WHEN skewness(CAST({c} AS DOUBLE)) > 0.5 THEN 'right-skewed' WHEN skewness(CAST({c} AS DOUBLE)) "
             "< -0.5 THEN 'left-skewed' WHEN skewness(CAST({c} AS DOUBLE)) IS NOT NULL THEN 'symmetrical' END")
    o["skew_kurt"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT({c}) AS n, ROUND(skewness(CAST({c} AS DOUBLE)), 6) "
        f"AS skewness, ROUND(kurtosis(CAST({c} AS DOUBLE)), 6) AS kurtosis, {label.format(c=c)} AS skew_label "
        "FROM orders" for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])])
    o["skew_label"] = _union([f"SELECT '{c}' AS column_name, {label.format(c=c)} AS skew_label FROM events"
                              for c in ["event_id", "user_id", "value"]])
    o["normality_test"] = _union([_k2_sql(i, c, "events") for i, c in enumerate(["event_id", "user_id", "value"])])
    o["quantiles"] = _union([
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, ROUND(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) "
        "AS value FROM events" for c in ["value", "event_id"] for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]])
    o["box_stats"] = (
        "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med, "
        "quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) "
        "SELECT 'l_extendedprice' AS column_name, COUNT(l_extendedprice) AS n, ROUND(q1, 6) AS q1, "
        "ROUND(med, 6) AS median, ROUND(q3, 6) AS q3, "
        "min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low, "
        "max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        "COUNT(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) "
        "AS fliers FROM lineitem, q GROUP BY q1, med, q3")
    o["box_stats_by_category"] = (
        "WITH top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY COUNT(*) DESC, event_type LIMIT 15), "
        "q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, "
        "quantile_cont(value, 0.75) AS q3 FROM events WHERE event_type IN (SELECT event_type FROM top) GROUP BY 1) "
        "SELECT e.event_type AS category, COUNT(value) AS n, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, "
        "ROUND(q3, 6) AS q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, "
        "max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        "COUNT(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers "
        "FROM events e JOIN q USING (event_type) GROUP BY e.event_type, q1, med, q3")
    o["histogram"] = (
        "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), "
        "c AS (SELECT CAST(LEAST(FLOOR((value - lo) * (30 / (hi - lo))), 29) AS INTEGER) AS bin, COUNT(*) AS k "
        "FROM events, r WHERE value IS NOT NULL GROUP BY 1) "
        "SELECT CAST(g.i AS INTEGER) AS bin, ROUND(lo + g.i * ((hi - lo) / 30), 6) AS bin_start, "
        "ROUND(CASE WHEN g.i = 29 THEN hi ELSE lo + (g.i + 1) * ((hi - lo) / 30) END, 6) AS bin_end, "
        "coalesce(c.k, 0) AS count FROM range(30) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i")
    o["kde_curve"] = (
        "WITH r AS (SELECT COUNT(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd "
        "FROM events), p AS (SELECT n, lo, hi, sd * pow(n, -1.0 / 5.0) AS bw, (hi - lo) / 199 AS step, "
        "sd * pow(n, -1.0 / 5.0) / 64 AS fw FROM r), "
        "b AS (SELECT FLOOR((value - lo) / fw) AS b, COUNT(*) AS w FROM events, p "
        "WHERE value IS NOT NULL GROUP BY 1), "
        "pts AS (SELECT lo + (b + 0.5) * fw AS v, w FROM b, p) "
        "SELECT CAST(g.i AS INTEGER) AS point, ROUND(lo + g.i * step, 6) AS x, "
        "ROUND(sum(w * exp(-0.5 * pow((lo + g.i * step - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density, "
        "ROUND(sum(w * exp(-0.5 * pow((lo + g.i * step - v) / bw, 2))) / (n * bw * sqrt(2 * pi())) * n, 6) "
        "AS count_density FROM range(200) g(i), pts, p GROUP BY g.i, lo, step, n, bw")
    o["kde_exact"] = (
        "WITH r AS (SELECT COUNT(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd "
        f"FROM {LONG_TAIL}), p AS (SELECT n, lo, hi, sd * pow(n, -1.0 / 5.0) AS bw, (hi - lo) / 49 AS step FROM r) "
        "SELECT CAST(g.i AS INTEGER) AS point, ROUND(lo + g.i * step, 6) AS x, "
        "ROUND(sum(exp(-0.5 * pow((lo + g.i * step - value) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density "
        f"FROM range(50) g(i), {LONG_TAIL}, p GROUP BY g.i, lo, step, n, bw")
    o["kde_close_to_exact"] = "SELECT true AS within_1e4_of_the_peak, CAST(50 AS BIGINT) AS points"
    o |= _eda_oracles()
    o["distinct_counts_approx"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem"
        for i, c in enumerate(["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"])])
    o["corr_matrix"] = _corr_sql()
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    wide_cols = []
    for i in range(WIDE_COLUMNS - 1):
        x = f"CAST({base[i % 4]} AS DOUBLE) * {i + 1} + CAST({base[(i // 4) % 4]} AS DOUBLE)"
        wide_cols.append(f"CASE WHEN l_orderkey % {i + 2} = 0 THEN NULL ELSE {x} END AS c{i}" if i % 3 == 0 else f"{x} AS c{i}")
    last = WIDE_COLUMNS - 1
    corrs = ", ".join(f"corr(c{i}, c{j}) AS r{i}_{j}" for i in range(last) for j in range(i + 1, last))
    listed = ", ".join([f"{{'a': {a}, 'b': {b}, 'r': r{min(a, b)}_{max(a, b)}}}" for a in range(last) for b in range(last) if a != b]
                       + [f"{{'a': {a}, 'b': {a}, 'r': 1.0}}" for a in range(last)]
                       + [f"{{'a': {a}, 'b': {b}, 'r': NULL}}" for a, b in [(last, last)] + [
                           p for i in range(last) for p in ((i, last), (last, i))]])
    o["corr_matrix_wide"] = (
        f"WITH w AS (SELECT {', '.join(wide_cols)} FROM lineitem), m AS (SELECT {corrs} FROM w), "
        f"p AS (SELECT unnest([{listed}]) AS p FROM m) SELECT CAST(p.a AS INTEGER) AS pos_a, 'c' || p.a AS col_a, "
        "CAST(p.b AS INTEGER) AS pos_b, 'c' || p.b AS col_b, ROUND(p.r, 6) AS r FROM p")
    ends = [(7, "\u00a0", ""), (5, "", "\u3000"), (3, "\x1c", "\u2029"), (2, "\u200b", "")]
    pri = "CASE " + " ".join(f"WHEN o_orderkey % {m} = 0 THEN '{a}' || o_orderpriority || '{b}'" for m, a, b in ends) + (
        " ELSE o_orderpriority END")
    o["whitespace_blanks"] = (
        f"SELECT 'pri' AS column_name, COUNT(*) AS affected, min(pri) AS example FROM (SELECT {pri} AS pri FROM orders) "
        f"WHERE pri <> trim(pri, '{PYTHON_BLANKS}')")
    infinite = ("(SELECT event_id, CASE WHEN event_id % 20 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 20 = 10 THEN "
                "CAST('-inf' AS DOUBLE) ELSE value END AS value FROM events)")
    o["histogram_infinite"] = (
        f"WITH f AS (SELECT value FROM {infinite} WHERE isfinite(value)), r AS (SELECT min(value) AS lo, max(value) AS hi "
        "FROM f), c AS (SELECT CAST(LEAST(FLOOR((value - lo) * (30 / (hi - lo))), 29) AS INTEGER) AS bin, COUNT(*) AS k "
        "FROM f, r GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, ROUND(lo + i * ((hi - lo) / 30), 6) AS bin_start, "
        "ROUND(CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END, 6) AS bin_end, coalesce(k, 0) AS count "
        "FROM range(30) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = g.i")
    o["outliers_iqr_infinite"] = (
        f"SELECT value FROM {infinite}, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM "
        f"{infinite}) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
    o["iforest_infinite"] = "SELECT event_id, true AS is_iforest FROM events WHERE event_id % 10 = 0"
    o["outlier_flag_names"] = (
        f"SELECT event_id, value AS is_any, user_id AS iforest_score, user_id AS row, user_id AS x, CASE WHEN {_flag_sql('value')} "
        f"THEN 'Outlier' ELSE 'Normal' END AS is_outlier FROM events, {_bounds('events', 'value')} b")
    o["category_codes_names"] = (
        "SELECT o_orderkey, o_orderpriority AS _v, o_orderstatus AS _code, o_custkey AS row, "
        "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS _v_code FROM orders")
    pairs = []
    for i, a in enumerate(li_num):
        for j, b in enumerate(li_num):
            if i < j:
                pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) "
                             f"AS r, {i} AS pa, {j} AS pb FROM lineitem")
    o["top_corr_pairs"] = (f"SELECT col_a, col_b, ROUND(r, 6) AS r, ROUND(abs(r), 6) AS abs_r FROM "
                           f"({_union(pairs)}) WHERE abs(r) < 1 ORDER BY abs(r) DESC, pa, pb LIMIT 3")
    o["ols_trend"] = (
        "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope, "
        "ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, "
        "ROUND(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n "
        "FROM lineitem")
    o["group_means"] = (
        "SELECT event_type, ROUND(avg(event_id), 6) AS event_id, ROUND(avg(user_id), 6) AS user_id, "
        "ROUND(avg(value), 6) AS value FROM events WHERE event_type IN (SELECT event_type FROM events "
        "GROUP BY 1 ORDER BY COUNT(*) DESC, event_type LIMIT 20) GROUP BY 1 ORDER BY 1")
    cmp_parts = []
    for i, c in enumerate(["event_id", "user_id"]):
        cmp_parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, avg({c}) FILTER (WHERE o) AS om, "
            f"avg({c}) FILTER (WHERE NOT o) AS nm, stddev_samp({c}) FILTER (WHERE NOT o) AS ns, "
            "COUNT(*) FILTER (WHERE o) AS no, COUNT(*) FILTER (WHERE NOT o) AS nn FROM f")
    o["outlier_compare"] = (
        f"WITH f AS (SELECT *, {_flag_sql('value')} AS o FROM events, {_bounds('events', 'value')} b) "
        "SELECT position, column_name, ROUND(om, 6) AS outlier_mean, ROUND(nm, 6) AS normal_mean, "
        "ROUND(ns, 6) AS normal_std, coalesce(ns > 0 AND abs(om - nm) > 1.5 * ns, false) AS is_distinct, "
        "CASE WHEN coalesce(ns > 0 AND abs(om - nm) > 1.5 * ns, false) THEN CASE WHEN om > nm THEN 'higher' "
        f"ELSE 'lower' END END AS direction FROM ({_union(cmp_parts)}) WHERE no > 0 AND nn > 0")
    o["case_collisions"] = (
        f"SELECT lower(pri) AS lower_value, COUNT(*) AS variants, CAST(sum(k) AS BIGINT) AS rows, min(pri) AS first_spelling, "
        f"max(pri) AS last_spelling FROM (SELECT pri, COUNT(*) AS k FROM {F4} WHERE pri IS NOT NULL GROUP BY pri) "
        "GROUP BY lower(pri) HAVING COUNT(*) > 1")
    o["cardinality_class"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, "
        f"CASE WHEN COUNT(DISTINCT {c}) > 50 THEN 'high' WHEN COUNT(DISTINCT {c}) = 1 THEN 'constant' "
        f"WHEN COUNT(DISTINCT {c}) > 15 THEN 'moderate' END AS cardinality, "
        f"CASE WHEN COUNT(DISTINCT {c}) > 15 AND COUNT(DISTINCT {c}) <= 50 THEN COUNT(DISTINCT {c}) - 15 END "
        "AS more_than_shown FROM part" for i, c in enumerate(["p_name", "p_brand", "p_type"])])
    o["time_span"] = ("SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS start, max(o_orderdate) AS \"end\", "
                      "date_sub('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders")
    o["granularity"] = (
        "SELECT 'o_custkey' AS column_name, COUNT(DISTINCT o_custkey) AS unique_values, COUNT(*) AS rows, "
        "CASE WHEN COUNT(DISTINCT o_custkey) = COUNT(*) THEN 'one row per id' ELSE 'several rows per id' END "
        "AS granularity FROM orders")
    o["density_2d"] = (
        "WITH r AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, "
        "max(l_extendedprice) AS yh FROM lineitem) "
        "SELECT CAST(LEAST(FLOOR((l_quantity - xl) * (30 / (xh - xl))), 29) AS INTEGER) AS bin_x, "
        "CAST(LEAST(FLOOR((l_extendedprice - yl) * (30 / (yh - yl))), 29) AS INTEGER) AS bin_y, COUNT(*) AS count "
        "FROM lineitem, r WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2")
    o["entity_totals"] = ("SELECT o_custkey AS entity, ROUND(coalesce(sum(o_totalprice), 0.0), 6) AS total "
                          "FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
    o["pareto_segments"] = (
        f"SELECT entity, ROUND(total, 6) AS total, rank, ROUND(cumulative_value, 2) AS cumulative_value, "
        f"ROUND(cumulative_pct, 6) AS cumulative_pct, CASE WHEN cumulative_pct <= 80.0 THEN 'Top' ELSE 'Bottom' END "
        f"AS segment FROM {_pareto_sql()}")
    o["pareto_summary"] = (
        f"SELECT segment, COUNT(*) AS entities, ROUND(COUNT(*) * 100.0 / sum(COUNT(*)) OVER (), 6) AS pct_entities, "
        f"ROUND(sum(total), 6) AS value, ROUND(sum(total) * 100.0 / sum(sum(total)) OVER (), 6) AS pct_value "
        f"FROM (SELECT *, CASE WHEN cumulative_pct <= 80.0 THEN 'Top' ELSE 'Bottom' END AS segment "
        f"FROM {_pareto_sql()}) GROUP BY segment")
    o["pareto_split"] = (
        f"SELECT segment, COUNT(*) AS entities, ROUND(COUNT(*) * 100.0 / sum(COUNT(*)) OVER (), 6) AS pct_entities, "
        f"ROUND(sum(total), 2) AS value, ROUND(sum(total) * 100.0 / sum(sum(total)) OVER (), 6) AS pct_value "
        f"FROM (SELECT *, CASE WHEN cumulative_pct <= 80.0 THEN 'Top' ELSE 'Bottom' END AS segment "
        f"FROM {_pareto_sql()}) GROUP BY segment")
    o["segmentation"] = (
        "WITH t AS (SELECT event_id AS entity, coalesce(sum(value), 0.0) AS total FROM events WHERE event_id IS NOT NULL "
        "GROUP BY 1), r AS (SELECT total, sum(total) OVER (ORDER BY total DESC, entity ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND CURRENT ROW) / sum(total) OVER () * 100.0 AS pct FROM t) "
        "SELECT CASE WHEN pct <= 80.0 THEN 'Top' ELSE 'Bottom' END AS segment, COUNT(*) AS entities, "
        "ROUND(COUNT(*) * 100.0 / sum(COUNT(*)) OVER (), 6) AS pct_entities, ROUND(sum(total), 6) AS value, "
        "ROUND(sum(total) * 100.0 / sum(sum(total)) OVER (), 6) AS pct_value, 'event_id' AS id_column, "
        "'value' AS value_column FROM r GROUP BY 1")
    o["scatter_sample_spread"] = (
        "SELECT CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS band, true AS close FROM lineitem GROUP BY 1")
    o["iforest_extreme"] = ("SELECT true AS extreme_scores_highest, true AS extremes_flagged")
    o["distinct_values"] = ("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL "
                            "ORDER BY 1")

    o["detect_id_column"] = (
        "SELECT * FROM (" + _union([
            f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, COUNT(*) AS rows, "
            f"ROUND(COUNT(DISTINCT {c}) / COUNT(*), 6) AS ratio FROM orders" for i, c in [(0, "o_orderkey")]])
        + ") WHERE ratio > 0.8 ORDER BY position LIMIT 1")
    o["detect_entity_column"] = (
        "SELECT * FROM (" + _union([
            f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, COUNT(*) AS rows, "
            f"ROUND(COUNT(DISTINCT {c}) / COUNT(*), 6) AS ratio FROM events"
            for i, c in [(0, "event_id"), (2, "user_id")]])
        + ") WHERE ratio > 0.5 ORDER BY position LIMIT 1")
    o["detect_value_column"] = ("SELECT 4 AS position, 'value' AS column_name FROM events "
                                "HAVING bool_and(coalesce(value >= 0, false))")
    o["detect_time_column"] = "SELECT 'o_orderdate' AS column_name, CAST(NULL AS VARCHAR) AS format FROM orders LIMIT 1"
    o["detect_ts_columns"] = ("SELECT 'ts' AS time_column, 'value' AS value_column FROM events "
                              "HAVING min(value) < max(value)")
    o["detect_category_column"] = (
        "SELECT * FROM (" + _union([
            f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM events"
            for i, c in [(0, "event_type"), (1, "props")]]) + ") WHERE distinct_count BETWEEN 2 AND 20 "
        "ORDER BY position LIMIT 1")
    o["detect_facet_column"] = (
        "SELECT * FROM (" + _union([
            f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM part"
            for i, c in enumerate(["p_name", "p_brand", "p_type"])]) + ") WHERE distinct_count BETWEEN 2 AND 10 "
        "ORDER BY position LIMIT 1")
    o["detect_boxplot_column"] = (
        "SELECT * FROM (" + _union([
            f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM documents"
            for i, c in enumerate(["text", "lang", "source"])]) + ") WHERE distinct_count BETWEEN 0 AND 14 "
        "ORDER BY position LIMIT 1")
    td = TEXT_DATES.replace("{F4}", F4)
    o["datetime_candidates_parse"] = (
        "SELECT 1 AS position, 'made_on' AS column_name, 'parses' AS reason WHERE (SELECT COUNT(*) FILTER "
        f"(WHERE TRY_CAST(made_on AS TIMESTAMP) IS NULL) FROM {td}) = 0 "
        "UNION ALL SELECT 2, 'order_date_text', 'name'")
    o["detect_time_column_text"] = (
        f"SELECT CASE WHEN COUNT(*) FILTER (WHERE TRY_CAST(order_date_text AS TIMESTAMP) IS NULL) = 0 "
        f"THEN 'order_date_text' ELSE 'made_on' END AS column_name FROM {td}")
    o["outlier_verdict"] = (
        "SELECT CASE WHEN bool_or(is_distinct) THEN 'behavioural' ELSE 'statistical' END AS verdict, "
        f"COUNT(*) FILTER (WHERE is_distinct) AS distinct_columns FROM ({o['outlier_compare']})")
    o["outlier_flag_forest"] = "SELECT event_id, value, true AS agrees FROM events"
    o["outliers_combined_forest"] = "SELECT DISTINCT value, true AS agrees FROM events WHERE value IS NOT NULL"
    o["outlier_compare_forest"] = _union([f"SELECT '{c}' AS column_name, true AS agrees" for c in ("event_id", "user_id")])
    o["outlier_verdict_forest"] = "SELECT true AS agrees"
    o["outlier_flag_all"] = "SELECT COUNT(*) AS rows, true AS is_the_union FROM events"
    o["moderate_values"] = _union([
        f"SELECT '{c}' AS column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (SELECT {c} AS value, COUNT(*) AS "
        f"count, row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS rank, COUNT(*) OVER () AS d FROM part "
        f"WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 15 AND d BETWEEN 16 AND 50"
        for c in ("p_name", "p_brand", "p_type")])
    b3 = "CAST(LEAST(FLOOR(({c} - {a}) * (10 / ({b} - {a}))), 9) AS INTEGER)"
    o["density_3d"] = (
        "WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, "
        "max(l_extendedprice) AS y1, min(l_tax) AS z0, max(l_tax) AS z1 FROM lineitem) SELECT "
        + b3.format(c="l_quantity", a="x0", b="x1") + " AS bin_x, " + b3.format(c="l_extendedprice", a="y0", b="y1")
        + " AS bin_y, " + b3.format(c="l_tax", a="z0", b="z1") + " AS bin_z, COUNT(*) AS count FROM lineitem, r "
        "GROUP BY 1, 2, 3")
    o["pair_plot"] = _union([_pair_sql(a, b) for i, a in enumerate(EVENT_NUMBERS) for b in EVENT_NUMBERS[i:]])
    o["datetime_candidates"] = "SELECT 2 AS position, 'order_date_text' AS column_name, 'name' AS reason"
    o["invalid_dates"] = (
        "SELECT 2 AS position, 'order_date_text' AS column_name, 'iso' AS best_format, "
        f"COUNT(*) FILTER (WHERE order_date_text IS NOT NULL AND TRY_CAST(order_date_text AS TIMESTAMP) IS NULL) "
        f"AS failing_values FROM {F4} HAVING failing_values > 0")

    o["time_analysis"] = (f"SELECT day, ROUND(raw_mean, 6) AS raw_mean, ROUND(observed, 6) AS observed "
                          f"FROM {_daily_sql('events', 'ts', 'value')}")
    o["daily_resample"] = (f"SELECT day, ROUND(raw_mean, 6) AS raw_mean, ROUND(observed, 6) AS observed "
                           f"FROM {_daily_sql('orders', 'o_orderdate', 'o_totalprice')}")
    o["time_line"] = ("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, ROUND(avg(value), 6) AS mean, min(value) AS min, "
                      "max(value) AS max, COUNT(value) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 1")
    o["seasonal_decompose"] = _seasonal_sql()
    o["monthly_pattern"] = (
        f"SELECT CAST(month(day) AS INTEGER) AS month, monthname(min(day)) AS month_name, ROUND(avg(observed), 6) "
        f"AS mean FROM {_daily_sql('orders', 'o_orderdate', 'o_totalprice')} GROUP BY 1 ORDER BY 1")
    o["weekday_pattern"] = (
        f"WITH m AS (SELECT CAST(isodow(day) - 1 AS INTEGER) AS weekday, avg(observed) AS mean "
        f"FROM {_daily_sql('events', 'ts', 'value')} GROUP BY 1) "
        "SELECT CAST(g.i AS INTEGER) AS weekday, CASE g.i WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN "
        "'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END "
        "AS weekday_name, ROUND(m.mean, 6) AS mean FROM range(7) g(i) LEFT JOIN m ON m.weekday = g.i ORDER BY 1")

    o["column_report"] = (
        f"WITH b AS {_bounds('events', 'value')}, f AS (SELECT value, {_flag_sql('value')} AS o, "
        "(value < b.lo OR value > b.hi) AS is_iqr, (b.sd > 0 AND abs((value - b.mu) / b.sd) > 3) AS is_z "
        "FROM events, b) "
        "SELECT 'value' AS column_name, ROUND(avg(value), 6) AS mean, ROUND(quantile_cont(value, 0.5), 6) AS median, "
        "ROUND(stddev_samp(value), 6) AS std, ROUND(min(value), 6) AS min, ROUND(max(value), 6) AS max, "
        "COUNT(*) FILTER (WHERE value IS NULL) AS missing, ROUND(skewness(value), 6) AS skewness, "
        "ROUND(kurtosis(value), 6) AS kurtosis, CASE WHEN skewness(value) > 0.5 THEN 'right-skewed' "
        "WHEN skewness(value) < -0.5 THEN 'left-skewed' WHEN skewness(value) IS NOT NULL THEN 'symmetrical' END "
        f"AS skew_label, ROUND(({_k2_expr('value')})[2], 6) AS p_value, ({_k2_expr('value')})[2] >= 0.05 AS is_normal, "
        "COUNT(*) FILTER (WHERE is_iqr) AS iqr_outliers, COUNT(*) FILTER (WHERE is_z) AS z_outliers, "
        "COUNT(DISTINCT CASE WHEN o THEN value END) AS combined_outliers FROM f")
    o["column_report_forest"] = f"SELECT column_name, iqr_outliers, z_outliers, true AS agrees FROM ({o['column_report']})"
    o["cleaning_suggestions"] = (
        f"SELECT 'cleaning' AS section, 'qty' AS column_name, 'impute' AS \"check\", 'info' AS severity, "
        f"CAST(COUNT(*) FILTER (WHERE qty IS NULL) AS DOUBLE) AS metric, 'median or mean' AS detail FROM {F2} "
        f"UNION ALL SELECT 'cleaning', 'flag', 'impute', 'info', CAST(COUNT(*) FILTER (WHERE flag IS NULL) AS DOUBLE), "
        f"'mode or ''Unknown''' FROM {F2} "
        f"UNION ALL SELECT 'cleaning', NULL, 'duplicates', CASE WHEN d > 0 THEN 'warning' ELSE 'success' END, "
        f"CAST(d AS DOUBLE), CASE WHEN d > 0 THEN 'remove duplicate rows' ELSE 'no duplicate rows' END FROM "
        f"(SELECT coalesce(sum(k - 1), 0) AS d FROM (SELECT COUNT(*) AS k FROM {F2} GROUP BY l_orderkey, l_linenumber, qty, flag))")
    o["audit_report"] = _audit_sql()
    o["insights_report"] = _union([
        "SELECT 'shape' AS section, NULL AS column_name, 'rows' AS \"check\", 'info' AS severity, "
        "CAST(COUNT(*) AS DOUBLE) AS metric, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail FROM orders",
        "SELECT 'shape', NULL, 'columns', 'info', CAST(COUNT(*) AS DOUBLE), CAST(COUNT(*) AS VARCHAR) || ' columns' "
        "FROM information_schema.columns WHERE table_name = 'orders'",
        "SELECT 'columns', column_name, 'summary', 'info', CAST(unique_values AS DOUBLE), description FROM ("
        + _table_summary_sql("orders", ORDERS_COLS) + ")",
        "SELECT 'time', 'o_orderdate', 'time_span', 'info', CAST(date_sub('day', min(o_orderdate), max(o_orderdate)) "
        "AS DOUBLE), strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') "
        "FROM orders",
        "SELECT 'granularity', c, 'granularity', 'info', CAST(u AS DOUBLE), CASE WHEN u = n THEN 'one row per id' "
        "ELSE 'several rows per id' END FROM (SELECT c, u, n FROM (SELECT 'o_orderkey' AS c, 0 AS i, "
        "COUNT(DISTINCT o_orderkey) AS u, COUNT(*) AS n FROM orders UNION ALL SELECT 'o_custkey', 1, "
        "COUNT(DISTINCT o_custkey), COUNT(*) FROM orders) WHERE u * 1.0 / n > 0.8 ORDER BY i LIMIT 1)"])
    o["audit_report_documents"] = _audit_sql("documents", DOCUMENTS_COLS)
    info = "SELECT 'eda' AS section, '{c}' AS column_name, '{k}' AS check, 'info' AS severity, {m} AS metric, {d} AS detail"
    o["eda_report_documents"] = _union(
        [(info + " FROM documents").format(c=c, k=k, m=f"ROUND({f}, 6)", d="CAST(NULL AS VARCHAR)")
         for c in ("doc_id", "n_chars") for k, f in (("mean", f"avg({c})"), ("median", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"))]
        + [(info + " FROM (SELECT {c}, COUNT(*) AS k FROM documents WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 "
            "LIMIT 1)").format(c=c, k="top_category", m="CAST(k AS DOUBLE)", d=c) for c in ("text", "lang", "source")]
        + [(info + " FROM (SELECT corr(doc_id, n_chars) AS r FROM documents) WHERE abs(r) < 1").format(
            c="doc_id", k="correlated_with", m="ROUND(r, 6)", d="'n_chars'")])
    o["eda_bars_documents"] = _union([
        f"SELECT '{c}' AS column_name, CASE WHEN {c} IN (SELECT {c} FROM documents WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY COUNT(*) DESC, {c} LIMIT 20) THEN {c} ELSE 'Other' END AS value, COUNT(*) AS count FROM documents "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in ("text", "lang", "source")])
    audit_part = f"SELECT * FROM ({o['audit_report_documents']}) WHERE section IN ('missing', 'duplicates', 'invalid', 'consistency')"
    o["one_click_documents"] = audit_part + " UNION ALL " + o["eda_report_documents"]
    o["table_summary_documents"] = _table_summary_sql("documents", DOCUMENTS_COLS)
    o["duplicate_count_zeros"] = (f"SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_rows FROM "
                                  f"(SELECT COUNT(*) AS k FROM {ZEROS} GROUP BY ALL)".replace("GROUP BY ALL",
                                  "GROUP BY z, gap, l_returnflag, l_linestatus, l_linenumber, note"))
    o["drop_duplicates_zeros"] = f"SELECT DISTINCT z, gap, l_returnflag, l_linestatus, l_linenumber, note FROM {ZEROS}"
    o["duplicate_count_texts"] = ("SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS duplicate_rows FROM "
                                  "(SELECT COUNT(*) AS k FROM documents GROUP BY text, lang)")
    o["cardinality_documents"] = _union([
        f"SELECT {i} AS position, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, "
        f"CASE WHEN COUNT(DISTINCT {c}) > 50 THEN 'high' WHEN COUNT(DISTINCT {c}) = 1 THEN 'constant' "
        f"WHEN COUNT(DISTINCT {c}) > 15 THEN 'moderate' END AS cardinality, "
        f"CASE WHEN COUNT(DISTINCT {c}) > 15 AND COUNT(DISTINCT {c}) <= 50 THEN COUNT(DISTINCT {c}) - 15 END "
        "AS more_than_shown FROM documents" for i, c in enumerate(["text", "lang", "source"])])
    return o


def _k2_expr(c: str, table: str | None = None) -> str:
    """[K², p] of column ``c`` in DuckDB aggregate form (same closed form as Spark)."""
    n = f"CAST(COUNT({c}) AS DOUBLE)"
    g1 = f"(skewness({c}) * ({n} - 2) / sqrt({n} * ({n} - 1)))"
    g2 = f"kurtosis_pop({c})"
    y = f"({g1} * sqrt(({n} + 1) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({beta2} - 1)))"
    delta = f"(1 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    zs = f"({delta} * asinh({y} / {alpha}))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    v = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"(({g2} + 3.0 - {e}) / sqrt({v}))"
    s = (f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6.0 * ({n} + 3) * ({n} + 5) / "
         f"({n} * ({n} - 2) * ({n} - 3))))")
    a = f"(6.0 + 8.0 / {s} * (2.0 / {s} + sqrt(1 + 4.0 / ({s} * {s}))))"
    den = f"(1 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    t2 = f"(sign({den}) * CASE WHEN {den} = 0 THEN NULL ELSE cbrt((1 - 2.0 / {a}) / abs({den})) END)"
    zk = f"((1 - 2.0 / (9.0 * {a}) - {t2}) / sqrt(2.0 / (9.0 * {a})))"
    k2 = f"({zs} * {zs} + {zk} * {zk})"
    return f"CASE WHEN {n} > 8 THEN [{k2}, exp(-{k2} / 2.0)] ELSE [NULL, NULL] END"


def _k2_sql(i: int, c: str, table: str) -> str:
    k = _k2_expr(f"CAST({c} AS DOUBLE)")
    return (f"SELECT {i} AS position, '{c}' AS column_name, COUNT({c}) AS n, ROUND(({k})[1], 6) AS statistic, "
            f"ROUND(({k})[2], 6) AS p_value, ({k})[2] >= 0.05 AS is_normal FROM {table}")


EVENTS_COLS = [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
               ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
               ("value", "double", "numeric"), ("props", "string", "categorical")]
ORDERS_COLS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
               ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
               ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical")]
DOCUMENTS_COLS = [("doc_id", "bigint", "numeric"), ("text", "string", "categorical"),
                  ("lang", "string", "categorical"), ("source", "string", "categorical"),
                  ("n_chars", "bigint", "numeric")]


def _table_summary_sql(table: str = "events", spec=None) -> str:
    parts = []
    for i, (c, t, k) in enumerate(spec or EVENTS_COLS):
        if k == "numeric":
            mean, std, mode = f"avg({c})", f"stddev_samp({c})", "CAST(NULL AS VARCHAR)"
            desc = f"printf('numbers with mean %.2f and deviation %.2f', avg({c}), stddev_samp({c}))"
        elif k == "datetime":
            mean, std, mode = "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
            desc = f"'times between ' || CAST(min({c}) AS VARCHAR) || ' and ' || CAST(max({c}) AS VARCHAR)"
        else:
            mean, std = "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"
            mode = (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, {c} LIMIT 1)")
            desc = f"'values, most often ' || coalesce({mode}, 'none')"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, COUNT(DISTINCT {c}) AS unique_values, "
            f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*), 6) AS missing_pct, "
            f"ROUND({mean}, 6) AS mean, ROUND({std}, 6) AS std, {mode} AS mode, {desc} AS description FROM {table}")
    return _union(parts)


def _audit_sql(table: str = "events", spec=None) -> str:
    """Findings of the audit of ``table`` computed per column in SQL (for tables
    without date-named columns)."""
    spec = spec or EVENTS_COLS
    cols = [c for c, _, _ in spec]
    nums = [c for c, _, k in spec if k == "numeric"]
    cats = [c for c, _, k in spec if k == "categorical"]
    ids = [(i, c) for i, c in enumerate(cols) if any(h in c.lower() for h in ("id", "key", "number"))]
    miss = [f"SELECT '{c}' AS c, {i} AS i, COUNT(*) FILTER (WHERE {c} IS NULL) AS k, COUNT(*) AS n FROM {table}"
            for i, c in enumerate(cols)]
    parts = [
        "SELECT 'missing' AS section, NULL AS column_name, 'missing_values' AS \"check\", 'success' AS severity, "
        f"0.0 AS metric, 'no missing values' AS detail FROM ({_union(miss)}) HAVING sum(k) = 0",
        "SELECT 'missing', c, 'missing_values', 'warning', k * 100.0 / n, "
        f"CAST(k AS VARCHAR) || ' missing (' || printf('%.1f', k * 100.0 / n) || '%)' FROM ({_union(miss)}) WHERE k > 0",
        "SELECT 'duplicates', NULL, 'duplicate_rows', CASE WHEN d > 0 THEN 'warning' ELSE 'success' END, d, "
        "CAST(d AS VARCHAR) || ' duplicate rows' FROM (SELECT coalesce(sum(k - 1), 0) AS d FROM "
        f"(SELECT COUNT(*) AS k FROM {table} GROUP BY {', '.join(cols)}))",
    ]
    idc = [f"SELECT '{c}' AS c, {i} AS i, COUNT(DISTINCT {c}) * 1.0 / COUNT(*) AS ratio, "
           f"COUNT(*) - COUNT(DISTINCT {c}) - CASE WHEN COUNT(*) > COUNT({c}) THEN 1 ELSE 0 END AS d FROM {table}"
           for i, c in ids]
    parts.append(
        "SELECT 'duplicates', c, 'duplicate_ids', CASE WHEN d > 0 THEN 'warning' ELSE 'success' END, d, "
        f"CAST(d AS VARCHAR) || ' duplicate IDs' FROM (SELECT * FROM ({_union(idc)}) WHERE ratio > 0.8 "
        "ORDER BY i LIMIT 1)")
    outl = []
    for c in nums:
        outl.append(
            f"SELECT '{c}' AS c, COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) AS k FROM {table}, "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) - 1.5 * (quantile_cont(CAST({c} AS DOUBLE), 0.75) "
            f"- quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.75) + 1.5 * "
            f"(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) AS hi FROM {table})")
    parts.append("SELECT 'invalid', c, 'iqr_outliers', 'warning', k, CAST(k AS VARCHAR) || ' values outside the "
                 f"IQR fences' FROM ({_union(outl)}) WHERE k > 0")
    ws = f"trim({{c}}, '{PYTHON_BLANKS}')"
    for c in cats:
        parts.append(
            f"SELECT 'consistency', '{c}', 'whitespace', 'warning', COUNT(*), 'example: ''' || min({c}) || '''' "
            f"FROM {table} WHERE {c} <> {ws.format(c=c)} HAVING COUNT(*) > 0")
        parts.append(
            f"SELECT 'consistency', '{c}', 'case_collisions', 'warning', COUNT(*), 'values differing only by case' "
            f"FROM (SELECT lower({c}) FROM (SELECT DISTINCT {c} FROM {table} WHERE {c} IS NOT NULL) GROUP BY 1 "
            "HAVING COUNT(*) > 1) HAVING COUNT(*) > 0")
        parts.append(
            f"SELECT 'consistency', '{c}', 'cardinality', 'info', nu, CASE WHEN nu > 50 THEN 'high cardinality' "
            "WHEN nu = 1 THEN 'single value' ELSE CAST(nu - 15 AS VARCHAR) || ' more beyond the top 15' END "
            f"FROM (SELECT COUNT(DISTINCT {c}) AS nu FROM {table}) WHERE nu > 15 OR nu = 1")
    body = _union(parts)
    return ("SELECT section, column_name, \"check\", severity, CAST(metric AS DOUBLE) AS metric, detail FROM ("
            + body + ")")


def oracle_sql() -> dict[str, str]:
    out = _oracle()
    if registry := _optional("tabscope.llm.queries"):
        out |= registry.oracle_sql()
    pipeline = _optional("corpus_pipeline")
    if pipeline and pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out
