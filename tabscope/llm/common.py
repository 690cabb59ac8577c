"""Shared helpers: shipping the package to the workers, shared scratch tables,
ordered buckets, grouped Arrow maps and connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import scratch_path

#: Sort key standing for a null document id: before every real id.
NULL_ID = -(2 ** 63)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session (once per context).

    The zip is handed to Spark's own file server, which every executor fetches from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tabscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tabscope-py-"), "tabscope_py.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "tabscope")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tabscope_shipped = True


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no lazy result reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str, sink: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage.

    ``sink`` gathers the paths a caller can drop once nothing reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if sink is not None:
        sink.append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(docs: DataFrame, buckets: int, accuracy: int = 10_000) -> list[int]:
    """Ascending distinct document ids that begin the second and later of ``buckets`` id ranges.

    One pass over the id column only; every bound is an id of the table.
    """
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    row = docs.select(key.alias("k")).agg(
        F.percentile_approx("k", probs, accuracy).alias("q"), F.min("k").alias("lo")).first()
    return sorted({int(x) for x in (row["q"] or [])} - {row["lo"]})


def bucket_of(key, bounds: list[int]):
    """0-based number of the id range that holds ``key``."""
    if not bounds:
        return F.lit(0)
    arr = F.lit([int(b) for b in bounds])
    return F.aggregate(arr, F.lit(0), lambda n, b: n + F.when(key >= b, 1).otherwise(0))


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]],
               schema: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Run ``fn`` once per key group, many small groups per task without per-group start-up.

    Rows are hash-partitioned on ``keys`` and sorted, so a task streams its groups
    one after another and holds one group (callers bound the group size).
    """
    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_pylist() for k in keys]
            ids = list(zip(*cols))
            start = 0
            for i, k in enumerate(ids):
                if k != last:
                    if last is not None:
                        if i > start:
                            held.append(batch.slice(start, i - start))
                        if held:
                            yield from fn(pa.Table.from_batches(held))
                    held, start, last = [], i, k
            if len(ids) > start:
                held.append(batch.slice(start, len(ids) - start))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def release() -> None:
    """Hand the memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)            # of the GNU C library
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` of an Arrow map that releases memory after each batch it yields and at its end.

    A Python worker lives on through the stages of a job, and what it keeps counts against its executor.
    """
    def each(batches):
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return each


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Gather row dicts into record batches of at most ``size`` rows."""
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each upper node ``b`` has one edge and is no lower node (one shuffle of pre-aggregated nodes)."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("x"), F.lit(0).alias("up")),
        F.struct(F.col("b").alias("x"), F.lit(1).alias("up")))).alias("e")).select("e.x", "e.up")
    bad = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter(
        (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; root = smallest node reachable.

    Alternates the large-star and small-star steps until the edge set is a forest
    of stars; each round is cut to a table in the shared folder and nothing but
    the answer of the star test reaches the driver. Edge rows are 16 bytes, so
    these tables are written in fewer files than the documents' shuffles have.
    """
    few = max(1, shuffle_parts(edges.sparkSession) // 8)
    old: list[str] = []
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    cur = cut(edges.select(lo.alias("a"), hi.alias("b")).filter("a < b").distinct().coalesce(few), "edges", old)
    for _ in range(max_rounds):
        if _is_star_forest(cur):
            break
        both = cur.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                            F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
                          ).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small star: each node hands its smaller neighbours (and itself) to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x"))
        new: list[str] = []
        nxt = cut(small.filter("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct().coalesce(few),
                  "edges", new)
        for path in old:
            drop_table(edges.sparkSession, path)
        cur, old = nxt, new
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
