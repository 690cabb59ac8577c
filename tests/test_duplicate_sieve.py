"""Repeated rows are found by a filter of their names; rows that stand alone do not move."""

from collections import Counter

import pytest

from tabscope.operators import profile

ROWS = [(i % 40 if i % 3 else 1000 + i, None if i % 7 == 0 else f"t{i % 40}", float("nan") if i % 11 == 0 else 0.5)
        for i in range(600)] + [(None, None, None)] * 3


@pytest.mark.parametrize("words", [1, 64, profile.SIEVE_WORDS])
def test_a_full_filter_loses_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(profile._sieved, "__defaults__", (words,))
    df = spark.createDataFrame(ROWS, "_w int, _row string, _h1 double").repartition(5)
    seen = Counter((a, b, None if c is None or c != c else c) for a, b, c in ROWS)
    assert Counter(tuple(r) for r in profile.drop_duplicates(df).collect()) == Counter(seen.keys())
    assert Counter(tuple(r) for r in profile.duplicate_rows(df).collect()) == Counter(
        {r: k for r, k in seen.items() if k > 1})


def test_no_row_is_suspected_without_repeats(spark):
    df = spark.range(5000).selectExpr("id", "cast(id as string) t")
    suspects, singles = profile._sieved(df)
    assert suspects.count() == 0 and singles.count() == 5000


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert profile.drop_duplicates(df).count() == 0 and profile.duplicate_rows(df).count() == 0
