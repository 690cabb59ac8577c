"""pandas anchors recorded in FIXTURES.md (sf0.01), recomputed with our operators."""

import pytest

from conftest import table
from tabscope.functions.stats import quantile_map
from tabscope.operators import detect, outliers, profile, relations, segment, timeseries, transform

approx = pytest.approx


def test_events_value_quartiles_and_outliers(spark):
    ev = table(spark, "events")
    q1, q3 = quantile_map(ev, ["value"], [0.25, 0.75])["value"]
    assert (q1, q3) == (approx(14.56), approx(69.1475))
    assert outliers.outliers_iqr(ev, "value").count() == 463
    assert outliers.outliers_zscore(ev, "value").count() == 182


def test_orders_totalprice_shape(spark):
    o = table(spark, "orders")
    q1, med, q3 = quantile_map(o, ["o_totalprice"], [0.25, 0.5, 0.75])["o_totalprice"]
    assert (q1, med, q3) == (approx(125475.5), approx(251485.485), approx(374367.44))
    r = profile.skew_kurt(o, ["o_totalprice"]).first()
    assert r["skewness"] == approx(-0.004927978666896, rel=1e-9)
    assert r["kurtosis"] == approx(-1.200781902304, rel=1e-9)


def test_lineitem_and_customer_fences(spark):
    li = table(spark, "lineitem")
    b = outliers.iqr_bounds(li, ["l_extendedprice"])["l_extendedprice"]
    assert (b[0], b[1]) == (approx(26881.1525), approx(79194.095))
    assert outliers.outliers_iqr(li, "l_extendedprice").count() == 0
    cu = table(spark, "customer")
    assert quantile_map(cu, ["c_acctbal"], [0.25, 0.75])["c_acctbal"] == [approx(1702.3325), approx(7359.7625)]
    neg = outliers.negative_values(cu.withColumnRenamed("c_acctbal", "amount")).first()
    assert neg["negative_count"] == 122


def test_top_correlated_pairs(spark):
    rows = relations.top_corr_pairs(table(spark, "lineitem")).collect()
    got = [(r["col_a"], r["col_b"], round(r["abs_r"], 6)) for r in rows]
    assert got == [("l_partkey", "l_tax", 0.008795), ("l_orderkey", "l_tax", 0.008631),
                   ("l_orderkey", "l_discount", 0.006675)]


def test_quantity_bins(spark):
    li = transform.bin_equal_width(table(spark, "lineitem"), "l_quantity", 5, "b")
    counts = {r["b"]: r["count"] for r in li.groupBy("b").count().collect()}
    assert [counts[i] for i in range(5)] == [12179, 11996, 12011, 11896, 11918]


def test_value_counts_and_mode(spark):
    seg = {r["value"]: r["count"] for r in profile.value_counts(table(spark, "customer"), "c_mktsegment").collect()}
    assert seg == {"MACHINERY": 308, "FURNITURE": 303, "BUILDING": 302, "AUTOMOBILE": 298, "HOUSEHOLD": 289}
    ev = [tuple(r) for r in profile.value_counts(table(spark, "events"), "event_type").collect()]
    assert ev == [("signup", 2017), ("error", 2014), ("click", 2006), ("view", 1982), ("purchase", 1981)]
    assert profile.mode_value(table(spark, "orders"), "o_orderpriority") == "4-NOT SPECIFIED"


def test_events_daily_and_seasonal(spark):
    daily = timeseries.daily_resample(table(spark, "events"), "ts", "value").orderBy("day").collect()
    assert len(daily) == 30
    assert daily[0]["observed"] == approx(49.88420329670329)
    assert daily[-1]["observed"] == approx(45.87449848024316)
    assert (daily[-1]["day"] - daily[0]["day"]).days == 29
    dec = timeseries.seasonal_decompose(timeseries.daily_resample(table(spark, "events"), "ts", "value"))
    phases = {r["phase"]: r["seasonal"] for r in dec.select("phase", "seasonal").distinct().collect()}
    expected = [-1.59321, 1.03546, -0.215899, 0.225715, -1.209385, 0.915301, 0.842018]
    assert [round(phases[i], 6) for i in range(7)] == [approx(e, abs=1e-6) for e in expected]


def test_orders_daily_gaps(spark):
    daily = timeseries.daily_resample(table(spark, "orders"), "o_orderdate", "o_totalprice")
    assert daily.count() == 2405
    assert daily.filter("raw_mean IS NULL").count() == 6
    assert daily.filter("observed IS NULL").count() == 0


def test_pareto_top_segment(spark):
    seg = segment.pareto_segments(table(spark, "orders"), "o_custkey", "o_totalprice")
    assert seg.count() == 1500
    assert seg.filter("segment = 'Top'").count() == 1010


@pytest.mark.parametrize("name,expected", [
    ("events", "event_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("orders", "o_orderkey"),
    ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("pages", "page_id"),
    ("lineitem", None), ("conversations", None)])
def test_audit_id_column(spark, name, expected):
    assert detect.id_column_name(table(spark, name)) == expected


@pytest.mark.parametrize("name,id_col,value_col", [
    ("events", "event_id", "value"), ("documents", "doc_id", None), ("labels", "doc_id", None),
    ("pages", "page_id", None), ("orders", None, "o_totalprice"), ("lineitem", None, "l_extendedprice"),
    ("part", None, "p_retailprice"), ("customer", None, None), ("supplier", None, None),
    ("conversations", None, None)])
def test_pareto_role_columns(spark, name, id_col, value_col):
    df = table(spark, name)
    assert detect._first(detect.detect_entity_column(df)) == id_col
    assert detect._first(detect.detect_value_column(df)) == value_col
