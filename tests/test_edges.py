"""In-code edge tables (FIXTURES.md F6)."""

import datetime as dt
import math

import numpy as np
import pytest

from tabscope.functions.missing import normalize_missing
from tabscope.functions.stats import quantile_map
from tabscope.operators import (chartdata, detect, outliers, profile, relations, segment, timeseries,
                                transform)
from tabscope.plans import audit_report, cleaning_suggestions, insights_report


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_empty_table(spark):
    df = frame(spark, [], "id bigint, amount double, cat string")
    assert profile.missing_summary(df).count() == 0
    assert profile.duplicate_count(df).first()[0] == 0
    assert quantile_map(df, ["amount"], [0.5])["amount"] == [None]
    assert chartdata.histogram(df, "amount").count() == 0
    assert outliers.outliers_iqr_counts(df).first()["outliers"] == 0
    ts = profile.table_summary(df).collect()
    assert [r["missing_pct"] for r in ts] == [None, None, None]
    assert audit_report(df).count() > 0
    assert segment.pareto_segments(df, "id", "amount").count() == 0
    assert relations.corr_matrix(df).filter("col_a <> col_b").first()["r"] is None


def test_one_and_two_rows(spark):
    one = frame(spark, [(1, 2.0)], "id bigint, v double")
    r = profile.skew_kurt(one, ["v"]).first()
    assert r["skewness"] is None and r["kurtosis"] is None
    assert profile.normality_test(one, ["v"]).first()["p_value"] is None
    assert quantile_map(one, ["v"], [0.25, 0.75])["v"] == [2.0, 2.0]
    assert outliers.outliers_zscore(one, "v").count() == 0
    two = frame(spark, [(1, 2.0), (2, 4.0)], "id bigint, v double")
    assert quantile_map(two, ["v"], [0.25, 0.5])["v"] == [2.5, 3.0]
    assert relations.corr_matrix(two).filter("col_a = 'id' AND col_b = 'v'").first()["r"] == pytest.approx(1.0)


def test_all_null_and_constant_columns(spark):
    df = frame(spark, [(i, None, 5.0) for i in range(10)], "id bigint, empty double, const double")
    miss = {r["column_name"]: r["missing_pct"] for r in profile.missing_summary(df).collect()}
    assert miss == {"empty": 100.0}
    dc = {r["column_name"]: r["distinct_count"] for r in profile.distinct_counts(df).collect()}
    assert dc == {"id": 10, "empty": 0, "const": 1}
    assert transform.handle_missing(df, "empty", "mode").filter("empty IS NULL").count() == 10
    scaled = transform.scale(df, ["const"], "standard").select("const").distinct().collect()
    assert [r[0] for r in scaled] == [0.0]
    assert transform.scale(df, ["const"], "minmax").select("const").distinct().first()[0] == 0.0
    assert outliers.outliers_iqr(df, "const").count() == 0
    assert outliers.outliers_zscore(df, "const").count() == 0
    assert profile.skew_kurt(df, ["const"]).first()["skewness"] is None
    for n, mid in [(5, 2), (4, 1)]:
        b = transform.bin_equal_width(df, "const", n, "b").select("b").distinct().collect()
        assert [r[0] for r in b] == [mid]
    h = chartdata.histogram(df, "const").filter("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in h] == [(15, 10)]
    assert relations.corr_matrix(df, ["id", "const"]).filter("col_a <> col_b").first()["r"] is None


def test_nan_beside_null(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    norm = normalize_missing(df)
    assert norm.filter("x IS NULL").count() == 2
    assert profile.missing_summary(df).first()["missing_count"] == 2
    assert profile.distinct_counts(df).first()["distinct_count"] == 2
    assert profile.numeric_report(df, "x").first()["mean"] == 2.0


def test_ties_and_negative_zero(spark):
    df = frame(spark, [("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    assert profile.mode_value(df, "s") == "a"
    assert [r["value"] for r in profile.value_counts(df, "s").collect()] == ["a", "b", "c"]
    z = frame(spark, [(0.0,), (-0.0,), (1.0,)], "x double")
    assert profile.distinct_counts(z).first()["distinct_count"] == 2


@pytest.mark.parametrize("x,flag", [(17.5, False), (17.6, True)])
def test_values_on_the_iqr_fence(spark, x, flag):
    df = frame(spark, [(v,) for v in [5.0] * 4 + [10.0] * 4 + [x]], "v double")
    b = outliers.iqr_bounds(df, ["v"])["v"]
    assert b[3] == 17.5
    assert (outliers.outliers_iqr(df, "v").count() == 1) == flag


def test_zscore_of_exactly_three_follows_numpy(spark):
    vals = [3.0, -3.0] + [0.0] * 16
    z = np.abs((np.array(vals) - np.mean(vals)) / np.std(vals))
    df = frame(spark, [(v,) for v in vals], "v double")
    assert outliers.outliers_zscore(df, "v").count() == int((z > 3).sum())


def _daily(spark, days):
    base = dt.datetime(2024, 1, 1)
    return frame(spark, [(base + dt.timedelta(days=d, hours=3), float(d)) for d in days], "t timestamp_ntz, v double")


def test_day_gaps_are_forward_filled(spark):
    out = timeseries.daily_resample(_daily(spark, [0, 1, 4]), "t", "v").orderBy("day").collect()
    assert [r["observed"] for r in out] == [0.0, 1.0, 1.0, 1.0, 4.0]
    assert [r["raw_mean"] for r in out] == [0.0, 1.0, None, None, 4.0]


@pytest.mark.parametrize("span,decomposed", [(14, False), (15, True)])
def test_decomposition_needs_more_than_14_days(spark, span, decomposed):
    daily = timeseries.daily_resample(_daily(spark, range(span + 1)), "t", "v")
    dec = timeseries.seasonal_decompose(daily)
    assert (dec.count() > 0) == decomposed


def test_tables_without_numeric_or_text(spark):
    text_only = frame(spark, [("a", "x"), ("b", "y")], "c1 string, c2 string")
    assert profile.numeric_summary_all(text_only).count() == 0
    assert relations.corr_matrix(text_only).count() == 0
    assert outliers.outliers_iqr_counts(text_only).count() == 0
    nums_only = frame(spark, [(1, 2.0), (2, 3.0)], "a bigint, b double")
    rows = audit_report(nums_only).filter("check = 'categorical_columns'").collect()
    assert rows and rows[0]["severity"] == "info"
    assert insights_report(nums_only).count() > 0
    assert cleaning_suggestions(nums_only).count() > 0
    assert detect._first(detect.detect_category_column(nums_only)) is None


def test_duplicates_with_nulls_in_different_columns(spark):
    swapped = frame(spark, [(None, 1), (1, None), (2, 2)], "a bigint, b bigint")
    assert profile.duplicate_count(swapped).first()[0] == 0
    dup = audit_report(swapped).filter("check = 'duplicate_rows'").first()
    assert dup["metric"] == 0.0
    same = frame(spark, [(None, 1), (None, 1), (2, None), (2, None), (2, None)], "a bigint, b bigint")
    assert profile.duplicate_count(same).first()[0] == 3
    assert audit_report(same).filter("check = 'duplicate_rows'").first()["metric"] == 3.0
    wide = frame(spark, [("x" * 50, None, 1.0), ("x" * 50, None, 1.0), (None, "x" * 50, 1.0)],
                 "s string, t string, v double")
    assert profile.duplicate_count(wide).first()[0] == 1
    assert profile.drop_duplicates(wide).count() == 2
