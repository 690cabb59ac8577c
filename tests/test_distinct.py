"""Distinct counts by sketch: errors, and detectors that agree with exact counts about their thresholds."""

import pytest
from pyspark.sql import functions as F

from tabscope.functions.distinct import EXACT, bounds, estimates
from tabscope.operators import detect, profile


def test_estimates_and_bounds(spark):
    sizes = [0, 1, 2, 20, EXACT, 65, 500, 20_000, 60_000]
    df = spark.range(60_000).select(*[(F.col("id") % n if n else F.lit(None).cast("long")).alias(f"c{n}") for n in sizes])
    guess, rows = estimates(df, {c: F.col(c).cast("string") for c in df.columns})
    assert rows == 60_000
    for n in sizes:
        lo, hi = bounds(guess[f"c{n}"])
        assert lo <= n <= hi and abs(guess[f"c{n}"] - n) <= 0.08 * n
    approx = {r["column_name"]: r["distinct_count"] for r in profile.distinct_counts(df, approx=True).collect()}
    assert approx == guess


@pytest.mark.parametrize("share", [0.79, 0.8, 0.8001, 0.81, 1.0])
def test_id_column_about_its_threshold(spark, share):
    n = 10_000
    keys = int(round(share * n))
    df = spark.range(n).select((F.col("id") % 7).alias("low_key"), (F.col("id") % keys).alias("some_id"),
                               F.col("id").alias("last_id"))
    got = detect.detect_id_column(df).first()
    want = ("some_id", keys) if keys / n > 0.8 else ("last_id", n)
    assert (got["column_name"], got["distinct_count"]) == want


@pytest.mark.parametrize("k", [1, 2, 10, 11, 14, 15, 20, 21, 70, 300])
def test_category_column_about_its_thresholds(spark, k):
    df = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("unique"),
                                  F.concat(F.lit("k"), F.col("id") % k).alias("cat"))
    for lo, hi in ((2, 20), (2, 10), (0, 14)):
        got = detect.detect_category_column(df, lo, hi).first()
        assert tuple(got) == ((1, "cat", k) if lo <= k <= hi else (0, "unique", 3000))
        assert (detect.detect_category_column(df, lo, hi, fallback=False).count() == 1) == (lo <= k <= hi)
    assert detect.detect_category_column(df.limit(0)).first()["distinct_count"] == 0
