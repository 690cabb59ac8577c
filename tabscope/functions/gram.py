"""Blocked Gram matrices: the sums of all column pairs of a wide table from one scan.

Each task turns its Arrow batches into column blocks X (shifted, missing values as
0) and masks M (1 where present) and adds up four products: counts M'M, sums X'M,
squares (X*X)'M and cross products X'X. Entry (i, j) then covers the rows in
which both columns are present. A task returns one row per column i (4 vectors of
m doubles); the rows of one column are added up as a stream where they meet, so a
task holds m x m doubles while it reads and 4 m while it adds, whatever the
number of rows. The result, m x m x 4 doubles, is the size of the matrix asked for.

Values are shifted by the mean of the column's first rows, which keeps the sums
small beside the spread; the shift cancels out of every result.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .missing import missing_safe

# The products run in Python workers, which need numpy and Arrow only, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows whose mean is the shift, and rows of a column block.
SHIFT_ROWS = 1000
BLOCK_ROWS = 8192


def _numbers(column: pa.Array) -> np.ndarray:
    """A column as doubles, missing values as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _task_products(m: int, shift: np.ndarray):
    def run(batches):
        counts, sums, squares, cross = (np.zeros((m, m)) for _ in range(4))
        low, high, seen = np.full(m, math.inf), np.full(m, -math.inf), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([_numbers(part.column(i)) for i in range(m)])
                here = ~np.isnan(x)
                low = np.minimum(low, np.where(here, x, math.inf).min(axis=0))
                high = np.maximum(high, np.where(here, x, -math.inf).max(axis=0))
                mask = here.astype(np.float64)
                # an infinite value has no products; its column is told by its bounds
                x = np.where(np.isfinite(x), x - shift, 0.0)
                counts += mask.T @ mask
                sums += x.T @ mask
                squares += (x * x).T @ mask
                cross += x.T @ x
                seen = True
        if seen:
            data = np.stack([counts, sums, squares, cross], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(m, dtype=np.int32)), pa.array(low), pa.array(high),
                 pa.array([row.tobytes() for row in data], type=pa.binary())], names=["i", "low", "high", "data"])
    return run


def _added(batches):
    last, total, low, high = None, None, None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([last], type=pa.int32()), pa.array([low]), pa.array([high]),
             pa.array([total.tobytes()], type=pa.binary())], names=["i", "low", "high", "data"])
    for batch in batches:
        for i, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("i", "low", "high", "data"))):
            own = np.frombuffer(data)
            if i != last:
                if last is not None:
                    yield row()
                last, total, low, high = i, own.copy(), lo, hi
            else:
                total += own
                low, high = min(low, lo), max(high, hi)
    if last is not None:
        yield row()


class Gram:
    """Pairwise-complete sums of ``cols``, shifted by ``shift``: ``counts, sums, squares, cross`` (m x m).

    ``sums[i, j]`` is the sum of column i over the rows in which i and j are present, ``squares`` that of its
    squares. ``infinite`` and ``constant`` tell columns with an infinite value and of one value (or none).
    """

    def __init__(self, df: DataFrame, cols: list[str]):
        m = len(cols)
        x = df.select(*[missing_safe(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
        real = [F.when(F.abs(f"c{i}") < F.lit(math.inf), F.col(f"c{i}")) for i in range(m)]
        head = x.limit(SHIFT_ROWS).select(*[v.alias(f"c{i}") for i, v in enumerate(real)]).agg(
            *[F.avg(f"c{i}").alias(f"c{i}") for i in range(m)]).first()
        self.shift = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in head])
        ddl = "i int, low double, high double, data binary"
        rows = (x.mapInArrow(_task_products(m, self.shift), ddl).repartition("i").sortWithinPartitions("i")
                .mapInArrow(_added, ddl).collect())                   # m rows: the matrix asked for
        total = np.zeros((m, 4, m))
        self.low, self.high = np.full(m, math.inf), np.full(m, -math.inf)
        for r in rows:
            total[r["i"]] = np.frombuffer(r["data"]).reshape(4, m)
            self.low[r["i"]], self.high[r["i"]] = r["low"], r["high"]
        self.counts, self.sums, self.squares, self.cross = (total[:, k, :] for k in range(4))
        self.infinite = (np.isinf(self.low) | np.isinf(self.high)) & (self.counts.diagonal() > 0)
        self.constant = (self.counts.diagonal() == 0) | (self.low == self.high)

    def moments(self, i: int, j: int):
        """(n, sx, sy, sxx, syy, sxy) over the rows with both columns, or None without a spread."""
        n = int(self.counts[i, j])
        if n < 2 or self.constant[i] or self.constant[j] or self.infinite[i] or self.infinite[j]:
            return None
        return (n, float(self.sums[i, j]), float(self.sums[j, i]), float(self.squares[i, j]),
                float(self.squares[j, i]), float(self.cross[i, j]))
