"""Role detectors (R1–R12): which column is the ID, time, value or category.

Names are matched as lower-case substrings on the driver (so ``width``
contains ``id``, as in the reference); statistics for all candidates come from
one aggregation (or one value-count shuffle), and the first match in column
order wins. Each detector returns a DataFrame with zero or one chosen row, plus a
``*_name`` helper that returns the plain column name for building later plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import best_formats, fully_parsing
from ..functions.missing import missing_safe
from ..functions.typeclass import (DATETIME_TYPES, NESTED_TYPES, categorical_columns,
                                   numeric_columns)
from ..functions.distinct import bounds, estimates
from .profile import distinct_counts, value_key

# Column-name fragments the reference looks for.
ID_HINTS = ["id", "key", "number"]
ENTITY_HINTS = ["id", "customer", "user"]
VALUE_HINTS = ["sales", "revenue", "price", "amount", "value"]
TIME_HINTS = ["date", "time"]


def _named(cols: list[str], hints: list[str]) -> list[str]:
    return [c for c in cols if any(h in c.lower() for h in hints)]


def _first(df: DataFrame) -> str | None:
    r = df.select("column_name").limit(1).collect()
    return r[0][0] if r else None


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def detect_id_column(df: DataFrame, hints: list[str] | None = None, ratio: float = 0.8) -> DataFrame:
    """First column whose name has an ID hint and whose distinct/rows ratio exceeds
    ``ratio`` (R1; R2 with ``ENTITY_HINTS`` and 0.5). Rows include missing ones."""
    hints = ID_HINTS if hints is None else hints
    cands = [c for c in _named(df.columns, hints)
             if not isinstance(df.schema[c].dataType, NESTED_TYPES)]
    ddl = "position int, column_name string, distinct_count bigint, rows bigint, ratio double"
    if not cands:
        return _empty(df, ddl)
    # sketches tell most candidates; values are counted only where the ratio is near, and for the column found
    guess, n = estimates(df, {c: value_key(df, c) for c in cands})
    rows = []
    for c in cands:
        if not n or bounds(guess[c])[1] <= ratio * n:
            continue
        k = distinct_counts(df, [c]).first()["distinct_count"]
        if k / n > ratio:
            rows.append((df.columns.index(c), c, k, n, k / n))
            break
    return df.sparkSession.createDataFrame(rows, ddl)


def detect_entity_column(df: DataFrame) -> DataFrame:
    return detect_id_column(df, ENTITY_HINTS, 0.5)


def detect_value_column(df: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """First numeric column with a value hint whose values are all present and ≥ 0."""
    cands = _named(numeric_columns(df), VALUE_HINTS if hints is None else hints)
    ddl = "position int, column_name string"
    if not cands:
        return _empty(df, ddl)
    agg = df.agg(*[F.bool_and(F.coalesce(missing_safe(df, c) >= 0, F.lit(False))).alias(f"ok{i}")
                   for i, c in enumerate(cands)])
    rows = agg.select(F.inline(F.array(*[
        F.struct(F.lit(df.columns.index(c)).alias("position"), F.lit(c).alias("column_name"),
                 F.col(f"ok{i}").alias("ok"))
        for i, c in enumerate(cands)])))
    return rows.filter(F.coalesce("ok", F.lit(True))).orderBy("position").limit(1).drop("ok")


def parse_status(df: DataFrame, cols: list[str]) -> dict:
    """``{col: (fully_parses, best_format, failing_values)}`` — datetime columns parse
    trivially; text columns by their best format (one aggregation); other types
    do not parse (DECISION: numbers are not read as epoch nanoseconds here)."""
    out = {}
    text = []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, DATETIME_TYPES):
            out[c] = (True, None, 0)
        elif isinstance(dt, T.StringType):
            text.append(c)
        else:
            out[c] = (False, None, None)
    for c, (fmt, parsed, present) in best_formats(df, text).items():
        out[c] = (parsed == present, fmt, present - parsed)
    return out


def detect_time_column(df: DataFrame) -> DataFrame:
    """A column named like a date/time whose values all parse, else the first
    text column that fully parses."""
    named = _named(df.columns, TIME_HINTS)
    st = parse_status(df, named)
    pick = next((c for c in named if st[c][0]), None)
    if pick is None:
        others = [c for c in categorical_columns(df) if c not in named]
        full = fully_parsing(df, others)
        pick = next((c for c in others if full[c] is not None), None)
        if pick is not None:
            st[pick] = (True, full[pick], 0)
    return _pick(df, pick, st)


def _pick(df: DataFrame, pick: str | None, st: dict) -> DataFrame:
    ddl = "column_name string, format string"
    if pick is None:
        return _empty(df, ddl)
    return df.sparkSession.createDataFrame([(pick, st.get(pick, (None, None))[1])], ddl)


def detect_ts_columns(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """R5 + R6: time column (first datetime-typed, else first named date/time column
    that parses) and value column (first numeric without id/key/number in its name
    having more than one distinct value, else the first numeric). ``ranges`` =
    ``{col: (min, max)}`` when already known saves the aggregation."""
    ddl = "time_column string, value_column string"
    time_col = next(iter([f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]), None)
    if time_col is None:
        named = _named(df.columns, TIME_HINTS)
        st = parse_status(df, named)
        time_col = next((c for c in named if st[c][0]), None)
    if time_col is None:
        return _empty(df, ddl)
    nums = numeric_columns(df)
    if not nums:
        return _empty(df, ddl)
    cands = [c for c in nums if not any(h in c.lower() for h in ID_HINTS)]
    value_col = None
    if cands and ranges is not None and all(c in ranges for c in cands):
        value_col = next((c for c in cands if ranges[c][0] is not None and ranges[c][0] < ranges[c][1]), None)
    elif cands:
        r = df.agg(*[(F.min(missing_safe(df, c)) < F.max(missing_safe(df, c))).alias(f"v{i}")
                     for i, c in enumerate(cands)]).first()
        value_col = next((c for i, c in enumerate(cands) if r[f"v{i}"]), None)
    value_col = value_col or nums[0]
    return df.sparkSession.createDataFrame([(time_col, value_col)], ddl)


def detect_category_column(df: DataFrame, lo: int = 2, hi: int = 20, fallback: bool = True) -> DataFrame:
    """First text column with ``lo`` ≤ distinct ≤ ``hi`` (R7: 2–20, R8: 2–10,
    R9: 0–14 without fallback); fallback to the first text column."""
    cats = categorical_columns(df)
    ddl = "position int, column_name string, distinct_count bigint"
    if not cats:
        return _empty(df, ddl)
    guess, _ = estimates(df, {c: value_key(df, c) for c in cats})
    for i, c in enumerate(cats):
        least, most = bounds(guess[c])
        if least <= hi and most >= lo:                       # counted only where it may fit
            k = distinct_counts(df, [c]).first()["distinct_count"]
            if lo <= k <= hi:
                return df.sparkSession.createDataFrame([(i, c, k)], ddl)
    if not fallback:
        return _empty(df, ddl)
    first = distinct_counts(df, cats[:1]).first()
    return df.sparkSession.createDataFrame([(0, cats[0], first["distinct_count"])], ddl)


def datetime_candidates(df: DataFrame) -> DataFrame:
    """Datetime-typed or date/time-named columns, plus text columns that fully parse."""
    named = set(_named(df.columns, TIME_HINTS))
    full = fully_parsing(df, [c for c in categorical_columns(df) if c not in named])
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = f.name
        if isinstance(f.dataType, DATETIME_TYPES):
            rows.append((i, c, "datetime type"))
        elif c in named:
            rows.append((i, c, "name"))
        elif full.get(c) is not None:
            rows.append((i, c, "parses"))
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, reason string")


def invalid_dates(df: DataFrame) -> DataFrame:
    """date/time-named columns that do not fully parse, with failing value counts
    (all such columns are checked, not only up to the first success)."""
    named = _named(df.columns, TIME_HINTS)
    st = parse_status(df, named)
    rows = [(df.columns.index(c), c, st[c][1], st[c][2]) for c in named if not st[c][0]]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, best_format string, failing_values bigint")


def id_column_name(df: DataFrame, hints=None, ratio: float = 0.8) -> str | None:
    return _first(detect_id_column(df, hints, ratio))


def category_column_name(df: DataFrame, lo: int = 2, hi: int = 20, fallback: bool = True) -> str | None:
    return _first(detect_category_column(df, lo, hi, fallback))
