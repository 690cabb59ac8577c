"""One duplicate path for all row widths; numbers and orders at the edges."""

import datetime as dt

from pyspark.sql import functions as F

from tabscope.operators import chartdata, profile
from tabscope.plans import audit


def _zeros(spark, wide):
    df = spark.createDataFrame([("a", 0.0), ("a", -0.0), ("b", float("nan")), ("b", None)], "k string, x double")
    return df.select("*", *[F.repeat("k", 500).alias(f"t{i}") for i in range(4)]) if wide else df


def test_signed_zero_and_nan_narrow_and_wide(spark):
    for wide in (False, True):
        df = _zeros(spark, wide)
        assert profile.duplicate_count(df).first()[0] == 2
        assert profile.drop_duplicates(df).count() == 2
        assert profile.duplicate_rows(df).count() == 4
        found = {r["check"]: r["metric"] for r in audit.audit_report(df).collect()}
        assert found["duplicate_rows"] == 2


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "x string, y string")
    assert profile.duplicate_count(df).first()[0] == 0


def test_other_is_one_row_everywhere(spark):
    df = spark.createDataFrame([(v,) for v in ["Other"] * 5 + ["a"] * 4 + ["b"] * 3 + ["c"] * 2], "v string")
    assert [tuple(r) for r in profile.topn_other(df, "v", 2).collect()] == [("Other", 10), ("a", 4)]


def test_long_texts_keep_modes_and_case_collisions(spark):
    long = "x" * 90
    df = spark.createDataFrame([(long + "b",), (long + "b",), (long + "B",), (long + "a",), ("s",)], "t string")
    modes = {r["column_name"]: r["mode"] for r in profile.column_modes(df, ["t"]).collect()}
    assert modes == {"t": long + "b"}
    found = {r["check"]: r["metric"] for r in audit.audit_report(df).collect()}
    assert found["case_collisions"] == 1 and found["duplicate_rows"] == 1
    flat = df.distinct()
    assert profile.column_modes(flat, ["t"]).first()["mode"] == "s"


def test_missing_bands_along_a_time_column(spark):
    rows = [(dt.datetime(2024, 1, 1 + i), None if i < 4 else 1) for i in range(8)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, x int")
    got = {r["band"]: r["missing_rate"] for r in profile.missing_bands(df, "t", 2).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_samples_repeat_points_as_often_as_they_occur(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(2).alias("x"))
    got = chartdata.scatter_sample(df, ["x"], 400).groupBy("x").count().collect()
    share = {r["x"]: r["count"] / 400 for r in got}
    assert abs(share[1] - 0.75) < 0.1


def test_numbers_named_like_times_are_no_dates(spark):
    found = audit.audit_report(spark.createDataFrame([(1,), (2,)], "lead_time int")).collect()
    assert not [r for r in found if r["check"] == "date_parse"]


def test_quantiles_within_a_gather_budget(spark):
    from tabscope.functions.stats import quantiles
    df = spark.range(5000).select(*[((F.col("id") * (7 + 2 * i)) % 4999).cast("double").alias(f"c{i}") for i in range(4)],
                                  (F.col("id") % 3).alias("g"))
    cols, probs = [f"c{i}" for i in range(4)], [0.1, 0.5]
    free = quantiles(df, cols, probs, accuracy=100)
    assert quantiles(df, cols, probs, accuracy=100, max_gather=900) == free
    by = quantiles(df, cols[:1], probs, by="g", groups=[0, 1, 2], accuracy=100)
    assert quantiles(df, cols[:1], probs, by="g", groups=[0, 1, 2], accuracy=100, max_gather=300) == by
