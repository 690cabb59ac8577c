"""Text → timestamp parsing with a format list.

Spark's plain cast is ISO-only, so other layouts need explicit patterns.
pandas infers one format from the data and turns values in other formats into
missing; here the default picks the single listed format that parses the most
values of the column (one aggregation for all candidates), and ``mixed=True``
takes the first format that parses each value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .missing import quote
from .typeclass import DATETIME_TYPES, is_numeric_type

ISO = "iso"
# Datetime layouts tried when parsing text ("iso" = Spark's cast rules).
DATE_FORMATS = [ISO, "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
                "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "M/d/yyyy", "dd-MM-yyyy",
                "dd.MM.yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy",
                "MMMM d, yyyy", "yyyyMMdd"]


def layout_guard(fmt: str) -> str:
    """A regular expression every text a layout can parse must match, derived from
    the pattern: numeric fields → digits, month names → letters, the rest literal.
    Parsing with a pattern fails by exception inside the JVM, which is slow, so
    values are only handed to the parser when their shape could fit."""
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        run = j - i
        if ch.isalpha():
            out.append(r"\p{L}+" if (ch == "M" and run >= 3) or ch in "EaG" else r"\d+")
        else:
            out.append(re.escape(fmt[i:j]))
        i = j
    out.append("$")
    return "".join(out)


def parse_with(col: Column, fmt: str) -> Column:
    """Parse text with one layout; failures → NULL. Result is TIMESTAMP_NTZ."""
    text = F.trim(col.cast("string"))
    if fmt == ISO:
        return text.try_cast("timestamp_ntz")
    return F.when(text.rlike(layout_guard(fmt)),
                  F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))


def to_timestamp_any(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """Column ``name`` as TIMESTAMP_NTZ: datetimes are cast, text is parsed with
    ``fmt`` (or ISO), numbers are read as epoch nanoseconds like pandas."""
    dt = df.schema[name].dataType
    col = F.col(quote(name))
    if isinstance(dt, DATETIME_TYPES):
        return col.cast("timestamp_ntz")
    if is_numeric_type(dt):
        return F.timestamp_micros(F.floor(col / 1000).cast("bigint")).cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        return parse_with(col, fmt or ISO)
    return F.lit(None).cast("timestamp_ntz")


def format_count_aggregates(names: list[str], formats: list[str] | None = None,
                            prefix: str = "_df") -> list:
    """Named aggregates counting, per text column, the values each layout parses
    (they can ride along in another pass; read back with ``formats_from``)."""
    formats = formats or DATE_FORMATS
    named = []
    for i, c in enumerate(names):
        col = F.col(quote(c))
        named.append((f"{prefix}n{i}", F.count(col), 1))
        for j, fmt in enumerate(formats):
            named.append((f"{prefix}p{i}_{j}", F.count(parse_with(col, fmt)), 1))
    return named


def formats_from(row: dict, names: list[str], formats: list[str] | None = None,
                 prefix: str = "_df") -> dict:
    """``{name: (best_format, parsed_count, non_null_count)}`` from the counts."""
    formats = formats or DATE_FORMATS
    out = {}
    for i, c in enumerate(names):
        counts = [row[f"{prefix}p{i}_{j}"] for j in range(len(formats))]
        best = max(range(len(formats)), key=lambda j: (counts[j], -j))
        out[c] = (formats[best], counts[best], row[f"{prefix}n{i}"])
    return out


def best_formats(df: DataFrame, names: list[str], formats: list[str] | None = None) -> dict:
    """For each text column: the format parsing the most values, and counts.

    Returns ``{name: (best_format, parsed_count, non_null_count)}`` from one
    aggregation over all candidate columns and formats (ties: the earlier listed
    format)."""
    from .aggs import agg_row
    if not names:
        return {}
    return formats_from(agg_row(df, format_count_aggregates(names, formats)), names, formats)


def fully_parsing(df: DataFrame, names: list[str], formats: list[str] | None = None) -> dict:
    """``{name: format or None}``: a layout that parses every non-missing value.

    A layout can only parse every value if it parses the column's smallest and
    largest values, so only those layouts are counted over the data; ordinary
    text columns cost a single min/max pass."""
    from .aggs import agg_row
    formats = formats or DATE_FORMATS
    if not names:
        return {}
    ends = agg_row(df, [e for i, c in enumerate(names) for e in (
        (f"lo{i}", F.min(F.col(quote(c))), 1), (f"hi{i}", F.max(F.col(quote(c))), 1),
        (f"n{i}", F.count(F.col(quote(c))), 1))])
    probes = [(f"{i}_{j}", parse_with(F.lit(ends[f"lo{i}"]), fmt).isNotNull()
               & parse_with(F.lit(ends[f"hi{i}"]), fmt).isNotNull())
              for i in range(len(names)) if ends[f"lo{i}"] is not None
              for j, fmt in enumerate(formats)]
    hit = df.sparkSession.range(1).select(*[e.alias(a) for a, e in probes]).first().asDict() if probes else {}
    cands = {i: [j for j in range(len(formats)) if hit.get(f"{i}_{j}")] for i in range(len(names))}
    named = [(f"p{i}_{j}", F.count(parse_with(F.col(quote(c)), formats[j])), 1)
             for i, c in enumerate(names) for j in cands[i]]
    r = agg_row(df, named) if named else {}
    out = {}
    for i, c in enumerate(names):
        n = ends[f"n{i}"]
        out[c] = "iso" if n == 0 else next(
            (formats[j] for j in cands[i] if r[f"p{i}_{j}"] == n), None)
    return out


def parse_mixed(col: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(*[parse_with(col, f) for f in (formats or DATE_FORMATS)])
