"""Global order-dependent numbers (positions, running sums) without a single task.

A window with no ``partitionBy`` moves every row into one task. Instead the
rows are range-partitioned on the full sort key (so ties on the leading key are
split by the next key and no range is over-full), the result is checkpointed to
the shared checkpoint folder so partition ids stay stable if executors are lost
and work is recomputed, the per-partition totals (one row per partition) are
prefix-summed, and each partition adds its offset to a partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _parts(df: DataFrame, parts: int | None) -> int:
    if parts:
        return parts
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def range_partitioned(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Range-partition on ``order`` and tag rows with a stable ``_part`` id."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.repartitionByRange(_parts(df, parts), *order)
              .withColumn("_part", F.spark_partition_id()))
    return tagged.checkpoint(eager=True)


def with_global_running_sum(df: DataFrame, order: list[Column], value: str,
                            out: str = "running", pos: str | None = None,
                            parts: int | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` in ``order`` (and optionally the 0-based
    position ``pos``) over the whole DataFrame."""
    ranked = range_partitioned(df, order, parts)
    per_part = ranked.groupBy("_part").agg(F.sum(value).alias("_ps"),
                                           F.count(F.lit(1)).alias("_pc"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part",
        F.coalesce(F.sum("_ps").over(before), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_offc"))
    within = Window.partitionBy("_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    res = ranked.join(F.broadcast(offsets), "_part")   # one row per partition: bounded
    res = res.withColumn(out, F.col("_off") + F.sum(value).over(upto))
    if pos:
        res = res.withColumn(pos, F.col("_offc") + F.row_number().over(within) - 1)
    return res.drop("_part", "_off", "_offc")


def with_global_position(df: DataFrame, order: list[Column], pos: str = "pos",
                         parts: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in ``order`` over the whole DataFrame."""
    ones = df.withColumn("_one", F.lit(1))
    return with_global_running_sum(ones, order, "_one", out="_cnt", pos=pos,
                                   parts=parts).drop("_one", "_cnt")
