"""Isolation forest on one numeric column (D3) as a Spark job.

1. Sample: the ``n_trees × 256`` rows with the smallest draws (``functions.sampling``:
   one scan for the count, one for the draw, about that many rows move); it holds
   every row when the column is smaller, in which case each tree draws its own
   ``min(256, n)`` rows from it. Infinite values are not drawn, but scored.
2. Build: ``groupBy(tree).applyInPandas`` grows one tree per group with numpy
   (random split uniform between the node's min and max, depth limit
   ceil(log2(sample))). With one feature a tree is a step function of the
   value, emitted as ``(tree, breakpoint, delta)`` rows.
3. Combine: the summed step function has at most ``n_trees × 255`` breakpoints —
   a size fixed by the parameters, never by the data — and is broadcast.
4. Score: a vectorised ``pandas_udf`` does a ``searchsorted`` per Arrow batch;
   score = 2^(−E[h]/c(ψ)), flagged when > 0.5 (``contamination='auto'``).

Random numbers differ from scikit-learn, so results are checked by properties
(deterministic per seed, score in (0, 1), extremes score high), not by value.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import missing_safe
from ..functions.sampling import bottom_k

# The tree builder and the scorer run in Python workers. Pickling this module's
# functions by value means executors need only numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649


def avg_path(m: float) -> float:
    """c(m): average path length of an unsuccessful BST search among m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int):
    """Leaves of one isolation tree as (upper_edge, path_length) in value order;
    the last leaf's upper edge is +inf. Splits send x <= threshold left."""
    leaves = []

    def rec(vals: np.ndarray, depth: int, upper: float):
        lo, hi = vals.min(), vals.max()
        if depth >= limit or len(vals) <= 1 or lo == hi:
            leaves.append((upper, depth + avg_path(len(vals))))
            return
        t = rng.uniform(lo, hi)
        if t >= hi:            # guard the open upper end of uniform
            t = lo
        rec(vals[vals <= t], depth + 1, t)
        rec(vals[vals > t], depth + 1, upper)

    rec(values, 0, math.inf)
    return leaves


def _tree_steps(seed: int, limit: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        vals = np.sort(pdf["v"].to_numpy(dtype="float64"))
        rng = np.random.default_rng([seed, tree])
        leaves = _grow(vals, rng, limit)
        edges = [u for u, _ in leaves[:-1]]
        paths = [p for _, p in leaves]
        deltas = [paths[i + 1] - paths[i] for i in range(len(paths) - 1)]
        rows = [(tree, None, paths[0])] + [(tree, e, d) for e, d in zip(edges, deltas)]
        return pd.DataFrame(rows, columns=["tree", "edge", "delta"])
    return build


def isolation_forest_scores(df: DataFrame, col: str, n_trees: int = 100, sample_size: int = 256,
                            seed: int = 42) -> DataFrame:
    """Adds ``iforest_score`` (anomaly score in (0, 1)) and ``is_iforest`` to ``df``."""
    x = missing_safe(df, col).cast("double")
    present = df.select(x.alias("v")).filter(F.abs("v") < F.lit(math.inf))
    k = n_trees * sample_size
    top = bottom_k(present, k, seed, draw="h").persist(StorageLevel.MEMORY_AND_DISK)   # ≤ k rows
    n = top.count()
    if n <= 1:
        top.unpersist()
        return df.withColumn("iforest_score", F.lit(None).cast("double")).withColumn(
            "is_iforest", F.lit(False))
    psi = min(sample_size, n)
    limit = int(math.ceil(math.log2(psi))) if psi > 1 else 0
    if n >= k:
        # large input: the top-k rows are dealt round-robin to the trees
        sample = top.withColumn("tree", F.pmod(F.row_number().over(Window.orderBy("h", "v")), F.lit(n_trees)))
    else:
        # small input (all rows are in the top-k): every tree draws its own sample
        per_tree = top.select("v", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), "h")
        per_tree = per_tree.withColumn("th", F.xxhash64("h", "tree", F.lit(seed)))
        w = Window.partitionBy("tree").orderBy("th", "v")
        sample = per_tree.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
    steps = (sample.select("tree", "v").groupBy("tree")
             .applyInPandas(_tree_steps(seed, limit), "tree long, edge double, delta double"))
    rows = steps.collect()          # ≤ n_trees × sample_size rows: bounded by parameters
    top.unpersist()
    base = sum(r["delta"] for r in rows if r["edge"] is None)
    pts = sorted((r["edge"], r["delta"]) for r in rows if r["edge"] is not None)
    edges = np.array([e for e, _ in pts], dtype="float64")
    cum = np.cumsum(np.array([d for _, d in pts], dtype="float64")) if pts else np.zeros(0)
    cpsi = avg_path(psi)
    bc = df.sparkSession.sparkContext.broadcast((edges, cum, float(base), n_trees, cpsi))

    @F.pandas_udf(T.DoubleType())
    def score(v: pd.Series) -> pd.Series:
        e, c, b, k, cp = bc.value
        arr = v.to_numpy(dtype="float64", na_value=np.nan)
        idx = np.searchsorted(e, arr, side="left")       # edges strictly below x
        total = b + np.where(idx > 0, c[np.maximum(idx - 1, 0)] if len(c) else 0.0, 0.0)
        s = np.power(2.0, -(total / k) / cp)
        s[np.isnan(arr)] = np.nan
        return pd.Series(s)

    out = df.withColumn("iforest_score", score(x))
    return out.withColumn("is_iforest", F.coalesce(F.col("iforest_score") > 0.5, F.lit(False)))


def isolation_forest_flags(df: DataFrame, col: str, seed: int = 42, **kw) -> DataFrame:
    return isolation_forest_scores(df, col, seed=seed, **kw)


def outliers_iforest(df: DataFrame, col: str, seed: int = 42) -> DataFrame:
    """Values flagged by the isolation forest (D3), one row per flagged row."""
    s = isolation_forest_scores(df, col, seed=seed)
    return s.filter("is_iforest").select(missing_safe(s, col).cast("double").alias("value"),
                                         F.col("iforest_score").alias("score"))
