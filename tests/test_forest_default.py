"""The combined outliers use all three methods unless the forest is left out by name."""

from pyspark.sql import functions as F

from conftest import SF001, table
from tabscope.operators import iforest, outliers
from tabscope.plans import column_report


def test_values_that_only_the_forest_flags_are_combined_outliers(spark):
    ev = table(spark, "events", SF001).select("event_id", "user_id", "value")
    rows = iforest.isolation_forest_flags(outliers.outlier_flags(ev, "value", iforest=False), "value").collect()
    only = {r["event_id"] for r in rows if r["is_iforest"] and not r["is_any"]}
    any_ = {r["event_id"] for r in rows if r["is_iforest"] or r["is_any"]}
    values = {r["value"] for r in rows if r["event_id"] in any_}
    assert only
    assert [r["value"] for r in outliers.outliers_combined(ev, "value").collect()] == sorted(values)
    flagged = outliers.outlier_flag(ev, "value")
    assert flagged.columns == [*ev.columns, "is_outlier"]
    assert {r["event_id"] for r in flagged.filter("is_outlier = 'Outlier'").collect()} == any_
    assert column_report(ev, "value").first()["combined_outliers"] == len(values)
    got = {r["column_name"]: r["outlier_mean"] for r in outliers.outlier_compare(ev, "value").collect()}
    want = ev.filter(F.col("event_id").isin(list(any_))).agg(F.avg("event_id")).first()[0]
    assert abs(got["event_id"] - want) < 1e-6 * want
    two = outliers.outlier_flag(ev, "value", iforest=False).filter("is_outlier = 'Outlier'").collect()
    assert not only & {r["event_id"] for r in two}
