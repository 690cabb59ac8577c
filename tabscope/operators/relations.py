"""Relations between columns.

Pairwise correlations come from plain sums of mean-shifted values (codegen-
friendly, numerically stable); Spark's ``corr`` is avoided because its buffer is
six fields per pair (wide matrices leave whole-stage codegen) and under ANSI mode
it raises on a constant column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import agg_row
from ..functions.gram import Gram
from ..functions.missing import missing_safe, quote
from ..functions.typeclass import numeric_columns
from .profile import top_values


def _x(df: DataFrame, name: str) -> Column:
    return missing_safe(df, name).cast("double")


#: Columns from which on the pairs' sums come from Gram matrices in one scan instead of one aggregate a pair.
WIDE = 13
#: Part of a sum of squares that is rounding: a smaller spread counts as none.
ROUNDING = 1e-14


def corr_pre_aggregates(df: DataFrame, cols: list[str]) -> list:
    """The first-pass statistics ``corr_matrix`` needs (can ride along in another pass)."""
    xs = [_x(df, c) for c in cols]
    return [e for i in range(len(cols)) for e in (
        (f"_cm{i}", F.count_if(xs[i].isNull()), 1), (f"_ca{i}", F.avg(xs[i]), 2),
        (f"_cs{i}", F.stddev_pop(xs[i]), 3))] + [("_cn", F.count(F.lit(1)), 1)]


class PairSums:
    """Mean-shifted sums of every column pair; gives Pearson r and the least-squares line
    of any pair without another pass. Few columns take two codegen-friendly scans of
    plain sums, ``WIDE`` or more one scan of Gram matrices. An infinite value leaves
    the pairs of its column without r and line."""

    def __init__(self, df: DataFrame, cols: list[str], pre: dict | None = None):
        self.cols = cols
        m = len(cols)
        self.gram = Gram(df, cols) if m >= WIDE else None
        if self.gram is not None:
            self.mean, self.constant = self.gram.shift.tolist(), self.gram.constant.tolist()
            return
        xs = [_x(df, c) for c in cols]
        pre = pre or agg_row(df, corr_pre_aggregates(df, cols))
        self.mean = [v if v is not None and math.isfinite(v) else 0.0 for v in (pre[f"_ca{i}"] for i in range(m))]
        self.has_null = [pre[f"_cm{i}"] > 0 for i in range(m)]
        self.constant = [not pre[f"_cs{i}"] for i in range(m)]
        self.n_all = pre["_cn"]
        d = [xs[i] - F.lit(self.mean[i]) for i in range(m)]
        named = []
        for i in range(m):
            if not self.has_null[i]:
                named += [(f"sx{i}", F.sum(d[i]), 1), (f"sxx{i}", F.sum(d[i] * d[i]), 1)]
        for i in range(m):
            for j in range(i + 1, m):
                if self.constant[i] or self.constant[j]:
                    continue
                if self.has_null[i] or self.has_null[j]:
                    both = xs[i].isNotNull() & xs[j].isNotNull()
                    di, dj = F.when(both, d[i]), F.when(both, d[j])
                    named += [(f"n{i}_{j}", F.count(di), 1), (f"x{i}_{j}", F.sum(di), 1),
                              (f"y{i}_{j}", F.sum(dj), 1), (f"xx{i}_{j}", F.sum(di * di), 1),
                              (f"yy{i}_{j}", F.sum(dj * dj), 1)]
                named.append((f"p{i}_{j}", F.sum(d[i] * d[j]), 1))
        self.sums = agg_row(df, named) if named else {}

    def _moments(self, i: int, j: int):
        """(n, sx, sy, sxx, syy, sxy) over the pairwise-complete rows, shifted by the means."""
        if self.gram is not None:
            return self.gram.moments(i, j)
        s, (a, b) = self.sums, (min(i, j), max(i, j))
        if self.constant[a] or self.constant[b]:
            return None
        if self.has_null[a] or self.has_null[b]:
            n, sa, sb = s[f"n{a}_{b}"], s[f"x{a}_{b}"], s[f"y{a}_{b}"]
            saa, sbb = s[f"xx{a}_{b}"], s[f"yy{a}_{b}"]
        else:
            n, sa, sb, saa, sbb = self.n_all, s[f"sx{a}"], s[f"sx{b}"], s[f"sxx{a}"], s[f"sxx{b}"]
        if not n or n < 2 or sa is None:
            return None
        sab = s[f"p{a}_{b}"]
        if not all(map(math.isfinite, (sa, sb, saa, sbb, sab))):
            return None                            # an infinite value among them
        return (n, sa, sb, saa, sbb, sab) if i < j else (n, sb, sa, sbb, saa, sab)

    def r(self, i: int, j: int):
        mo = self._moments(i, j)
        if mo is None:
            return None
        n, sx, sy, sxx, syy, sxy = mo
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        if vx <= ROUNDING * sxx or vy <= ROUNDING * syy:
            return None
        return (sxy - sx * sy / n) / math.sqrt(vx * vy)

    def line(self, i: int, j: int):
        """(slope, intercept, r², n) of column j on column i, or None."""
        mo = self._moments(i, j)
        if mo is None:
            return None
        n, sx, sy, sxx, syy, sxy = mo
        vx = sxx - sx * sx / n
        if vx <= ROUNDING * sxx:
            return None
        slope = (sxy - sx * sy / n) / vx
        mx, my = self.mean[i] + sx / n, self.mean[j] + sy / n
        r = self.r(i, j)
        return slope, my - slope * mx, None if r is None else r * r, n


def corr_matrix(df: DataFrame, cols: list[str] | None = None, pre: dict | None = None,
                sums: PairSums | None = None) -> DataFrame:
    """Long-form correlation matrix ``(col_a, col_b, r)`` for every ordered pair of
    numeric columns (booleans excluded); empty with fewer than two columns.

    Wide tables take one scan of Gram matrices (``functions.gram``). Others take
    two scans of plain sums, both inside whole-stage codegen: the first gets each
    column's mean, missing count and spread; the second sums products of
    mean-shifted values (the stable two-pass form). Pairs of complete columns
    share per-column sums; a pair touching a column with missing values sums over
    its pairwise-complete rows only. r is NULL for a constant column and for one with
    an infinite value."""
    cols = numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    schema = "pos_a int, col_a string, pos_b int, col_b string, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    ps = sums or PairSums(df, cols, pre)
    rows = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            r = ps.r(i, j)
            rows += [(i, cols[i], j, cols[j], r), (j, cols[j], i, cols[i], r)]
    rows += [(i, c, i, c, None if ps.constant[i] else 1.0) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, schema)


def top_corr_pairs(df: DataFrame, k: int = 3, cols: list[str] | None = None) -> DataFrame:
    """The ``k`` most correlated distinct pairs by |r| (A22, R10): perfect and self
    correlations (|r| = 1) are dropped; ties by column order."""
    m = corr_matrix(df, cols)
    return (m.filter((F.col("pos_a") < F.col("pos_b")) & (F.abs("r") < 1))
            .select("col_a", "col_b", "r", F.abs("r").alias("abs_r"), "pos_a", "pos_b")
            .orderBy(F.col("abs_r").desc(), "pos_a", "pos_b").limit(k)
            .drop("pos_a", "pos_b"))


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares trend line of ``y`` on ``x``."""
    xs, ys = _x(df, x), _x(df, y)
    return df.agg(F.lit(x).alias("x"), F.lit(y).alias("y"),
                  F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
                  F.regr_r2(ys, xs).alias("r2"), F.regr_count(ys, xs).alias("n"))


def group_means(df: DataFrame, cat: str, cols: list[str] | None = None, top: int = 20) -> DataFrame:
    """Mean of every numeric column per category, restricted to the ``top`` most
    frequent categories, alphabetical (A24) — one grouped aggregation."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != cat]
    keep = top_values(df, cat, top)
    v = missing_safe(df, cat)
    return (df.filter(v.isin(keep)).groupBy(v.alias(cat))
            .agg(*[F.avg(_x(df, c)).alias(c) for c in cols])
            .orderBy(quote(cat)))
