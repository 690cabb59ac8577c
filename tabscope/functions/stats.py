"""Statistical building blocks shared by the operators.

* ``quantiles`` — exact linear-interpolated quantiles (pandas' default) that
  never hold a whole column in one task: one mergeable KLL sketch per column
  brackets all its target ranks, one pass then counts what lies between the
  brackets and the values inside them — at most ``max_bracket`` values, a bound
  known before they are gathered — and a running count reads the exact order
  statistics. A bracket that is too wide is narrowed by another sketch first.
  Spark's own exact ``percentile`` keeps a value→count map of the whole column
  in the final task, which does not survive 100 TB; ``method="approx"`` gives
  the plain ``percentile_approx`` answer in one pass.
* Bias-corrected skewness/kurtosis from Spark's population moments.
* D'Agostino's K² normality test as a closed-form column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggs import agg_row
from .missing import quote

DEFAULT_ACCURACY = 10000
DEFAULT_MAX_BRACKET = 200_000
#: Rows that all brackets of one aggregate may gather together, over columns, probabilities and groups.
DEFAULT_MAX_GATHER = 2_000_000


def _c(name: str) -> Column:
    return F.col(quote(name)).cast("double")


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (the form pandas' quantile uses); an infinite end, if there is one, between two ends."""
    if a == b or t == 0:
        return a
    d = b - a
    if math.isinf(d):
        return a if math.isinf(a) and not math.isinf(b) else b if math.isinf(b) and not math.isinf(a) else math.nan
    if t >= 0.5:
        return b - d * (1.0 - t)
    return a + d * t


def _lookup(values: dict, key: Column | None) -> Column:
    """``values[key]`` as a column (a literal when there is one group and no key)."""
    if key is None:
        return F.lit(next(iter(values.values())))
    return F.create_map(*[x for g, v in values.items() for x in (F.lit(g), F.lit(v))])[key]


def _grouped_rows(df: DataFrame, key: Column | None, groups: list, named: list) -> dict:
    """Run ``named`` aggregates globally (key None) or per group → ``{group: row dict}``."""
    if key is None:
        return {0: agg_row(df, named)}
    rows = (df.filter(key.isin(groups)).groupBy(key.alias("_qg"))
            .agg(*[e.alias(a) for a, e, _ in named]).collect())     # one row per group (few)
    return {r["_qg"]: r.asDict() for r in rows}


def _sketch_size(accuracy: int) -> int:
    return max(8, min(65_535, int(accuracy) * 2 // 5))


def _rank_error(k: int) -> float:
    """Share of the rows by which a rank in a KLL sketch of size ``k`` is off, at 99 % confidence."""
    return 2.296 / k ** 0.9723


def _sketched(x: Column, fractions: list[float], k: int) -> Column:
    """Values at ``fractions`` by one sketch; NULL without values."""
    at = F.array(*[F.lit(min(1.0, max(0.0, f))) for f in fractions])
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(k)), at))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None,
              groups: list | None = None, method: str = "exact",
              accuracy: int = DEFAULT_ACCURACY,
              max_bracket: int = DEFAULT_MAX_BRACKET, extra: list | None = None,
              max_gather: int = DEFAULT_MAX_GATHER) -> dict:
    """Quantiles of ``cols`` at ``probs`` → ``{(group, col, p): float | None}``.

    Missing values are skipped (the column must already be NaN-normalised); infinite
    ones count as the least and greatest. With ``by`` the statistics are per group, for
    the given ``groups`` (expected to be few, e.g. a top-N list).

    Pass 1 gives the counts and one sketch per column, which brackets every wanted
    rank (three times the sketch's error to each side). Pass 2 unpivots the rows to
    (column, place among the brackets, value if in a bracket) and counts them —
    partial aggregation leaves a task one row per place and bracketed value — and a
    running count over these few rows finds the exact order statistics, on the
    executors. Brackets expected to hold more than ``max_bracket`` rows are narrowed
    by a sketch of their own rows first, and one pass gathers ``max_gather`` rows at
    most, so many wide brackets are read in several passes. A rank that the sketch
    missed is sought anew in the whole column. Two passes are typical.
    ``extra`` = ``[(alias, aggregate, width)]`` are computed in the first pass too
    (ungrouped only) and returned under ``"__extra__"``, saving a scan for callers
    that need plain statistics as well.
    """
    cols = list(cols)
    probs = [float(p) for p in probs]
    if not cols or not probs:
        return {}
    key = None if by is None else F.col(quote(by))
    group_values = [0] if by is None else [g for g in (groups or []) if g is not None]
    out: dict = {}
    if by is not None:
        for g in groups or []:
            if g is None:
                out.update({(None, c, p): None for c in cols for p in probs})
    if not group_values:
        return out
    max_bracket = max(int(max_bracket), 8)       # two ranks, the ends and room to narrow
    size = _sketch_size(max(int(accuracy), 100))
    margin = 3 * _rank_error(size)
    name = (lambda g: None) if by is None else (lambda g: g)

    # pass 1: counts and brackets for every column (and group)
    fractions = [f for p in probs for f in (p - margin, p + margin)]
    named = list(extra or []) if key is None else []
    for ci, c in enumerate(cols):
        x = _c(c)
        told = (_sketched(x, fractions, size) if method != "approx" else
                F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy))
        named += [(f"_qn{ci}", F.count(x), 1), (f"_qa{ci}", told, 1)]
    first = _grouped_rows(df, key, group_values, named)
    if extra and key is None:
        out["__extra__"] = {a: first[0][a] for a, _, _ in extra}

    brackets = []
    for g in group_values:
        row = first.get(g)
        for ci, c in enumerate(cols):
            n = int(row[f"_qn{ci}"] or 0) if row else 0
            for pi, p in enumerate(probs):
                if n == 0:
                    out[(name(g), c, p)] = None
                    continue
                if method == "approx":
                    out[(name(g), c, p)] = float(row[f"_qa{ci}"][pi])
                    continue
                low, high = (float(v) for v in row[f"_qa{ci}"][2 * pi:2 * pi + 2])
                h = (n - 1) * p
                k = int(math.floor(h))
                brackets.append(_Bracket(g, ci, p, (k, min(int(math.ceil(h)), n - 1)), h - k,
                                         low if p > margin else -math.inf, high if p < 1 - margin else math.inf,
                                         n * 2 * margin + 2))
    for _ in range(64):
        todo = [b for b in brackets if b.values is None]
        if not todo:
            break
        now = _share_out(todo, max_bracket, max_gather)
        if now:
            _read(df, cols, key, now)
        wide = [b for b in todo if b.values is None and not any(b is x for x in now)]
        if wide and not now:
            _narrow(df, cols, key, wide, size, margin, max_bracket)
    else:
        raise RuntimeError("quantile bracket did not converge")
    for b in brackets:
        out[(name(b.group), cols[b.col], b.p)] = _lerp(*b.values, b.part)
    return out


@dataclass
class _Bracket:
    """Values ``low`` to ``high`` between which the two order statistics ``ranks`` are sought; ``part`` of the way
    from the first to the second is the quantile. ``rows`` are expected inside."""
    group: object
    col: int
    p: float
    ranks: tuple[int, int]
    part: float
    low: float
    high: float
    rows: float
    values: tuple | None = None


def _share_out(todo: list, max_bracket: int, max_gather: int) -> list:
    """The brackets to read now, the smallest first."""
    used, now = 0, []
    for b in sorted(todo, key=lambda b: b.rows):
        if b.rows <= max_bracket and (not used or used + b.rows <= max_gather):
            used += b.rows
            now.append(b)
    return now


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The union of closed intervals as disjoint ones in ascending order."""
    out: list = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _read(df: DataFrame, cols: list[str], key: Column | None, now: list) -> None:
    """Read the order statistics of brackets from one pass over the rows."""
    groups = list(dict.fromkeys(b.group for b in now))
    entries = []
    for ci in sorted({b.col for b in now}):
        spans = {g: _merged([(b.low, b.high) for b in now if b.group == g and b.col == ci]) for g in groups}
        slots = max(map(len, spans.values()))
        x = _c(cols[ci])
        place = None
        for j in range(slots):                  # an unused slot lies above all values
            low = _lookup({g: s[j][0] if j < len(s) else math.inf for g, s in spans.items()}, key)
            high = _lookup({g: s[j][1] if j < len(s) else -math.inf for g, s in spans.items()}, key)
            place = F.when(x < low, 2 * j) if place is None else place.when(x < low, 2 * j)
            place = place.when(x <= high, 2 * j + 1)
        place = F.when(x.isNotNull(), place.otherwise(2 * slots))
        entries.append(F.struct(F.lit(ci).alias("c"), place.alias("r"), x.alias("x")))
    source = df if key is None else df.filter(key.isin(groups))
    group = F.lit(0) if key is None else key
    cells = source.select(group.alias("g"), F.explode(F.array(*entries)).alias("e")).filter(F.col("e.r").isNotNull())
    inside = F.when(F.col("e.r") % 2 == 1, F.col("e.x"))
    counted = cells.groupBy("g", F.col("e.c").alias("c"), F.col("e.r").alias("r"), inside.alias("x")).agg(
        F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "c").orderBy("r", "x"))     # bracketed values: max_gather at most
    ranks: dict = {}
    for b in now:
        ranks.setdefault((b.group, b.col), set()).update(b.ranks)
    hit = None
    for (g, ci), ks in ranks.items():
        own = (F.col("c") == ci) & F.exists(F.lit(sorted(ks)).cast("array<long>"),
                                            lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))
        own = own if key is None else own & (F.col("g") == F.lit(g))
        hit = own if hit is None else hit | own
    found: dict = {}
    for r in counted.withColumn("upto", upto).filter(hit).collect():            # a row for each wanted rank
        found.setdefault((0 if key is None else r["g"], r["c"]), []).append((r["upto"] - r["n"], r["upto"], r["x"]))
    for b in now:
        values = [next((x for lo, hi, x in found.get((b.group, b.col), []) if lo <= k < hi), None) for k in b.ranks]
        if None in values:                      # the sketch missed the rank: seek it in all rows
            b.low, b.high, b.rows = -math.inf, math.inf, math.inf
        else:
            b.values = tuple(values)


def _narrow(df: DataFrame, cols: list[str], key: Column | None, wide: list, size: int, margin: float,
            max_bracket: int) -> None:
    """Narrow brackets by a sketch of the rows strictly inside them; a frequent value at an end is one to read."""
    def column(b):
        x = _c(cols[b.col])
        return x if key is None else F.when(key == F.lit(b.group), x)
    counts = []
    for i, b in enumerate(wide):
        x = column(b)
        counts += [F.count_if(x < F.lit(b.low)).alias(f"b{i}"), F.count_if(x == F.lit(b.low)).alias(f"e{i}"),
                   F.count_if((x > F.lit(b.low)) & (x < F.lit(b.high))).alias(f"s{i}"),
                   F.count_if(x <= F.lit(b.high)).alias(f"u{i}")]
    r = df.agg(*counts).first()
    sketches = []
    for i, b in enumerate(wide):
        start, inside = r[f"b{i}"] + r[f"e{i}"], r[f"s{i}"]          # ranks before and of the strict interior
        if not (r[f"b{i}"] <= b.ranks[0] and b.ranks[1] < r[f"u{i}"]):
            b.low, b.high, b.rows = -math.inf, math.inf, math.inf    # the sketch missed: all rows
        elif inside + 2 <= max_bracket:
            b.rows = inside + 2
        else:
            at = [(k - start) / (inside - 1) for k in b.ranks]
            x = column(b)
            inner = F.when((x > F.lit(b.low)) & (x < F.lit(b.high)), x)
            sketches.append((b, at, inside, _sketched(inner, [at[0] - margin, at[1] + margin], size)))
    if not sketches:
        return
    r = df.agg(*[e.alias(f"q{i}") for i, (_, _, _, e) in enumerate(sketches)]).first()
    for i, (b, at, inside, _) in enumerate(sketches):
        low, high = (float(v) for v in r[f"q{i}"])
        if at[0] > margin:
            b.low = low
        if at[1] < 1 - margin:
            b.high = high
        b.rows = inside * (2 * margin + max(at[1], 0.0) - min(at[0], 1.0)) + 2


def quantile_map(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict:
    """``{col: [q(p) for p in probs]}`` for the ungrouped case."""
    q = quantiles(df, cols, probs, **kw)
    return {c: [q[(None, c, float(p))] for p in probs] for c in cols}


# ---------------------------------------------------------------- moments

def skew_bias_corrected(n: Column, g1: Column) -> Column:
    """pandas' ``skew`` (G1) from the population skewness g1; NULL for n < 3."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_bias_corrected(n: Column, g2: Column) -> Column:
    """pandas' ``kurtosis`` (G2, excess) from the population excess g2; NULL for n < 4."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def with_k2(df: DataFrame, n: str, g1: str, g2: str, stat: str = "statistic",
            p_value: str = "p_value") -> DataFrame:
    """Add D'Agostino–Pearson K² and its p-value (chi-square, 2 d.f.) to ``df``.

    ``g1`` is the population skewness and ``g2`` the population excess kurtosis,
    exactly Spark's ``skewness``/``kurtosis``. Closed form, no UDF; intermediate
    terms are separate projections so the generated code stays small. NULL for 8
    values or fewer, where the test is not defined.
    """
    nn = F.when(F.col(n) > 8, F.col(n)).cast("double")       # fewer values: all terms are NULL
    steps = [
        ("_y", F.col(g1) * F.sqrt((nn + 1) * (nn + 3) / (6.0 * (nn - 2)))),
        ("_beta2", 3.0 * (nn * nn + 27 * nn - 70) * (nn + 1) * (nn + 3)
         / ((nn - 2) * (nn + 5) * (nn + 7) * (nn + 9))),
        ("_w2", -1 + F.sqrt(2 * (F.col("_beta2") - 1))),
        ("_delta", 1 / F.sqrt(0.5 * F.log(F.col("_w2")))),
        ("_alpha", F.sqrt(2.0 / (F.col("_w2") - 1))),
        ("_zs", F.col("_delta") * F.asinh(F.col("_y") / F.col("_alpha"))),
        ("_e", 3.0 * (nn - 1) / (nn + 1)),
        ("_v", 24.0 * nn * (nn - 2) * (nn - 3) / ((nn + 1) * (nn + 1) * (nn + 3) * (nn + 5))),
        ("_x", (F.col(g2) + 3.0 - F.col("_e")) / F.sqrt(F.col("_v"))),
        ("_s", 6.0 * (nn * nn - 5 * nn + 2) / ((nn + 7) * (nn + 9))
         * F.sqrt(6.0 * (nn + 3) * (nn + 5) / (nn * (nn - 2) * (nn - 3)))),
        ("_a", 6.0 + 8.0 / F.col("_s") * (2.0 / F.col("_s") + F.sqrt(1 + 4.0 / (F.col("_s") * F.col("_s"))))),
        ("_den", 1 + F.col("_x") * F.sqrt(2.0 / (F.col("_a") - 4.0))),
        ("_t2", F.signum(F.col("_den")) * F.when(F.col("_den") == 0, F.lit(None)).otherwise(
            F.cbrt((1 - 2.0 / F.col("_a")) / F.abs(F.col("_den"))))),
        ("_zk", (1 - 2.0 / (9.0 * F.col("_a")) - F.col("_t2")) / F.sqrt(2.0 / (9.0 * F.col("_a")))),
        (stat, F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk")),
        (p_value, F.exp(-F.col(stat) / 2.0)),
    ]
    for name, e in steps:
        df = df.withColumn(name, e)
    return df.drop(*[name for name, _ in steps if name not in (stat, p_value)])
