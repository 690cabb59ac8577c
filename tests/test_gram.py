"""Gram matrices of wide tables against pandas, with missing, infinite and constant columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions.gram import Gram
from tabscope.operators import relations


def wide(n=2000, m=20, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m)) @ rng.normal(size=(m, m)) + 1e6 * rng.normal(size=m)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(m)])
    for i in range(0, m, 3):
        pdf.loc[rng.random(n) < 0.1 * (i % 4), f"c{i}"] = np.nan
    pdf["flat"] = 3.25
    pdf["none"] = np.nan
    pdf["pair"] = np.where(np.arange(n) < 2, pdf["c1"], np.nan)
    pdf["pairflat"] = np.where(np.arange(n) % 2 == 0, 4.5, pdf["c1"])
    pdf.loc[pdf.index % 2 == 1, "half"] = 1.0
    pdf.loc[pdf.index % 2 == 0, "half"] = np.nan
    return pdf


def test_wide_correlations_equal_pandas(spark):
    pdf = wide()
    df = spark.createDataFrame(pdf).repartition(9)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in relations.corr_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == len(pdf.columns) ** 2
    for (a, b), r in got.items():
        if a == b:
            continue
        w = want.loc[a, b]
        if r is None:
            assert np.isnan(w) or {a, b} & {"flat", "half", "pair"}
        else:
            assert r == pytest.approx(w, abs=1e-9), (a, b)
    assert got["c0", "flat"] is None and got["c0", "none"] is None and got["flat", "flat"] is None


def test_lines_of_wide_tables(spark):
    pdf = wide()
    df = spark.createDataFrame(pdf)
    sums = relations.PairSums(df, list(pdf.columns))
    both = pdf[["c1", "c4"]].dropna()
    slope, intercept = np.polyfit(both["c1"] - both["c1"].mean(), both["c4"], 1)
    s, i, r2, n = sums.line(1, 4)
    assert (s, n) == (pytest.approx(slope, rel=1e-9), len(both))
    assert i == pytest.approx(intercept - slope * both["c1"].mean(), rel=1e-6)
    assert r2 == pytest.approx(both.corr().iloc[0, 1] ** 2, rel=1e-9)


def test_infinite_values_and_empty_tables(spark):
    df = spark.range(100).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(14)])
    odd = df.withColumn("c3", F.when(F.col("c0") == 5, float("inf")).otherwise(F.col("c3")))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in relations.corr_matrix(odd).collect()}
    assert got["c3", "c1"] is None and got["c1", "c2"] == pytest.approx(df.corr("c1", "c2"), abs=1e-12)
    few = relations.corr_matrix(odd.select("c1", "c2", "c3")).collect()
    assert {r["r"] for r in few if "c3" in (r["col_a"], r["col_b"]) and r["col_a"] != r["col_b"]} == {None}
    none = relations.corr_matrix(df.limit(0)).collect()
    assert len(none) == 196 and all(r["r"] is None for r in none)


def test_one_scan_and_bounded_rows(spark):
    df = spark.range(0, 5000, 1, 11).select(*[(F.col("id") * F.lit(7 + i) % 101).cast("double").alias(f"c{i}") for i in range(60)])
    g = Gram(df, df.columns)
    assert g.counts.shape == (60, 60) and (g.counts == 5000).all()
    x = df.toPandas().to_numpy() - g.shift
    assert np.allclose(g.cross, x.T @ x) and np.allclose(g.sums[:, 0], x.sum(axis=0), atol=1e-6)
