"""Uniform samples: sizes, shares, rows that move, clashing names; the forest's scores from its steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01, table
from tabscope.functions.sampling import bottom_k, bottom_k_by
from tabscope.operators import chartdata, iforest, outliers, transform


@pytest.mark.parametrize("n,k", [(0, 10), (3, 10), (10, 10), (500, 10), (60_000, 1000)])
def test_sample_sizes(spark, n, k):
    df = spark.range(n).repartition(7)
    got = [r["id"] for r in bottom_k(df, k).collect()]
    assert len(got) == len(set(got)) == min(n, k)
    assert got == [r["id"] for r in bottom_k(df, k, n=n).collect()]


def test_samples_are_uniform(spark):
    df = spark.range(0, 100_000, 1, 16).select((F.col("id") % 4 == 0).alias("a"), (F.col("id") / 100_000).alias("u"))
    r = bottom_k(df, 4000, seed=3).agg(F.avg(F.col("a").cast("int")).alias("a"), F.avg("u").alias("u")).first()
    assert abs(r["a"] - 0.25) < 4 * math.sqrt(.25 * .75 / 4000) and abs(r["u"] - 0.5) < 4 * math.sqrt(1 / 12 / 4000)


def test_a_sample_moves_little_more_than_itself(spark):
    rows = bottom_k(spark.range(0, 400_000, 1, 8), 1000, n=400_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    from tabscope.functions import sampling
    kept = sampling._drawn(spark.range(0, 400_000, 1, 8).toDF("id"), 42).filter(
        sampling._under(F.col("h"), F.lit(sampling._reach(1000) / 400_000))).count()
    assert 1000 <= kept <= 1000 + 16 * math.sqrt(1000) + 64


def test_samples_of_groups(spark):
    g = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 700))
    df = spark.range(0, 90_000, 1, 6).select("id", g.alias("g"))
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    got = bottom_k_by(df, "g", 50)
    assert got.columns == ["id", "g"]
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {x: min(50, n) for x, n in sizes.items()}
    assert got.select("id").distinct().count() == got.count()


def test_samples_with_clashing_names(spark):
    df = spark.range(300).select(*[F.col("id").alias(c) for c in ("_n", "_b", "_r", "_h", "row", "h", "g", "n", "rank")])
    names = df.columns
    one = chartdata.scatter_sample(df, names, 20)
    assert one.columns == names and one.count() == 20
    by = chartdata.scatter_sample(df, names[:2], 20, by="rank", per_group=1)
    assert by.columns == ["_n", "_b", "rank"] and by.count() == 300


def test_forest_scores_follow_from_its_trees(spark):
    """Scores recomputed from the path lengths of every tree, value by value."""
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "value")
    k, psi = 100 * 256, 256
    n = ev.count()
    assert n < k
    seed = 42
    rows = bottom_k(ev.select(F.col("value").alias("v")), k, seed, draw="h")
    per = rows.select("v", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("tree"), "h").withColumn(
        "th", F.xxhash64("h", "tree", F.lit(seed))).toPandas()
    total = np.zeros(n)
    values = ev.orderBy("event_id").toPandas()["value"].to_numpy()
    for tree, part in per.groupby("tree"):
        v = np.sort(part.sort_values(["th", "v"])["v"].to_numpy()[:psi])
        leaves = iforest._grow(v, np.random.default_rng([seed, tree]), 8)
        edges = np.array([e for e, _ in leaves[:-1]])
        total += np.array([p for _, p in leaves])[np.searchsorted(edges, values, side="left")]
    want = 2.0 ** (-(total / 100) / iforest.avg_path(psi))
    got = iforest.isolation_forest_scores(ev, "value").orderBy("event_id").toPandas()
    assert np.allclose(got["iforest_score"], want, rtol=1e-9)
    assert (got["is_iforest"] == (want > 0.5)).all()


def test_names_of_callers_survive(spark):
    ev = table(spark, "events").limit(200).select("event_id", F.col("value"), *[
        F.lit(i).alias(c) for i, c in enumerate(("is_iqr", "is_z", "is_any", "is_iforest", "iforest_score", "row", "x"))])
    flag = outliers.outlier_flag(ev, "value")
    assert flag.columns == [*ev.columns, "is_outlier"]
    assert flag.drop("is_outlier").exceptAll(ev).count() == 0
    codes = transform.category_codes(ev.withColumn("_v", F.lit("a")).withColumn("key", F.lit(1)), "_v")
    assert {r["_v_code"] for r in codes.collect()} == {0} and "key" in codes.columns
