"""Data-quality audit (M1): missing values, duplicates, invalid values, consistency.

Scan budget: the per-column checks (missing, negatives, IQR outliers,
whitespace) are one fused aggregation after the quartile passes; distinct
counts, duplicate IDs, case collisions and cardinality all come from one
persisted value-count table (one shuffle); duplicate rows are one grouped
aggregation; date parsing is one aggregation over the date-named columns.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import agg_row
from ..functions.dates import format_count_aggregates, formats_from
from ..functions.missing import is_missing, missing_safe, normalize_missing, quote
from ..functions.stats import quantiles
from ..functions.typeclass import NESTED_TYPES, categorical_columns, numeric_columns
from ..operators.detect import ID_HINTS, TIME_HINTS, _named, parse_status
from ..operators.outliers import NON_NEGATIVE_HINTS, iqr_predicate, strip_ws
from ..operators.profile import ROW_KEY, duplicate_count_from_hashes, value_counts_long
from .findings import finding, findings_frame


def _fmt(x: float) -> str:
    return f"{x:.1f}"


def _date_text_columns(df: DataFrame) -> list[str]:
    return [c for c in _named(df.columns, TIME_HINTS) if isinstance(df.schema[c].dataType, T.StringType)]


def audit_checks(df: DataFrame) -> list:
    """The audit's per-column aggregates (missing, negatives, whitespace, date-layout
    counts); they can ride along in another pass (``quantiles(..., extra=...)``)."""
    cols = df.columns
    negs = [c for c in numeric_columns(df) if any(h in c.lower() for h in NON_NEGATIVE_HINTS)]
    checks = [("_n", F.count(F.lit(1)), 1)]
    checks += [(f"m{i}", F.count_if(is_missing(df, c)), 1) for i, c in enumerate(cols)]
    checks += [(f"neg{i}", F.count_if(missing_safe(df, c) < 0), 1) for i, c in enumerate(negs)]
    for i, c in enumerate(categorical_columns(df)):
        v = F.col(quote(c))
        bad = v.isNotNull() & (v != strip_ws(v))
        checks += [(f"w{i}", F.count_if(bad), 1), (f"we{i}", F.min(F.when(bad, v)), 1)]
    return checks + format_count_aggregates(_date_text_columns(df))


def audit_findings(df: DataFrame, id_ratio: float = 0.8, moderate_top: int = 15,
                   vc: DataFrame | None = None, numeric: dict | None = None,
                   quantile_method: str = "exact") -> list[tuple]:
    """Findings rows. ``vc`` is an optional shared value-count table
    (``value_counts_long``); ``numeric`` an optional shared quantile result for all
    numeric columns whose ``__extra__`` holds ``audit_checks(df)``. ``quantile_method="approx"``
    takes the IQR fences from one ``percentile_approx`` pass instead of exact quartiles."""
    df = normalize_missing(df)
    cols = df.columns
    nums = numeric_columns(df)
    cats = categorical_columns(df)
    negs = [c for c in nums if any(h in c.lower() for h in NON_NEGATIVE_HINTS)]

    # pass 1 of the quartile computation also counts missing values, negatives and
    # whitespace, so the per-column checks cost no scan of their own
    checks = audit_checks(df)
    if nums:
        q = numeric if numeric is not None else quantiles(df, nums, [0.25, 0.75], extra=checks,
                                                          method=quantile_method)
        r = dict(q["__extra__"])
        bounds = {}
        for c in nums:
            q1, q3 = q[(None, c, 0.25)], q[(None, c, 0.75)]
            bounds[c] = (None, None, None, None) if q1 is None else (
                q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        r.update(agg_row(df, [(f"o{i}", F.count_if(iqr_predicate(missing_safe(df, c).cast("double"),
                                                                    bounds[c])), 1)
                              for i, c in enumerate(nums)]))
    else:
        r = agg_row(df, checks)
    n = r["_n"]
    out = []

    # 1. missing values
    missing = [(c, r[f"m{i}"]) for i, c in enumerate(cols) if r[f"m{i}"] > 0]
    if not missing:
        out.append(finding("missing", None, "missing_values", "success", 0, "no missing values"))
    for c, k in missing:
        pct = k * 100.0 / n
        out.append(finding("missing", c, "missing_values", "warning", pct, f"{k} missing ({_fmt(pct)}%)"))

    # 2. duplicates (rows, then IDs from the value-count table)
    vc_cols = [c for c in cols if not isinstance(df.schema[c].dataType, NESTED_TYPES)]
    id_cands = _named(vc_cols, ID_HINTS)
    wanted = list(dict.fromkeys(id_cands + cats))
    # one value-count shuffle: distinct counts, duplicate IDs, case collisions and,
    # through the row-hash entry, whether any duplicate rows exist at all
    own = vc is None or not vc.filter(F.col("column_name") == ROW_KEY).limit(1).count()
    full = (value_counts_long(df, wanted, rows=True, compact=True).persist(StorageLevel.MEMORY_AND_DISK) if own else vc)
    dup = duplicate_count_from_hashes(df, full)
    out.append(finding("duplicates", None, "duplicate_rows", "warning" if dup > 0 else "success", dup,
                       f"{dup} duplicate rows"))
    stats = {}
    if wanted:
        vc = full.filter(F.col("column_name").isin(wanted))
        per_col = (vc.groupBy("column_name")
                   .agg(F.count(F.lit(1)).alias("nunique"), F.sum(F.col("count") - 1).alias("dups"))
                   .collect())
        stats = {row["column_name"]: (row["nunique"], row["dups"]) for row in per_col}
        collisions = {row["column_name"]: row["groups"] for row in (
            vc.filter(F.col("column_name").isin(cats))
            .groupBy("column_name", F.col("lower_value").alias("lv")).agg(F.count(F.lit(1)).alias("k"))
            .filter(F.col("k") > 1).groupBy("column_name").agg(F.count(F.lit(1)).alias("groups"))
            .collect())}
    else:
        collisions = {}
    if own:
        full.unpersist()
    id_col = None
    for c in id_cands:
        nu = stats.get(c, (0, 0))[0]
        if n and nu / n > id_ratio:
            id_col = c
            break
    if id_col is None:
        out.append(finding("duplicates", None, "duplicate_ids", "info", None, "no ID column detected"))
    else:
        nu, dups = stats[id_col]
        nulls = r[f"m{cols.index(id_col)}"]
        dup_ids = int(dups or 0) + max(nulls - 1, 0)
        out.append(finding("duplicates", id_col, "duplicate_ids", "warning" if dup_ids > 0 else "success",
                           dup_ids, f"{dup_ids} duplicate IDs"))

    # 3. invalid values
    for i, c in enumerate(negs):
        if r[f"neg{i}"] > 0:
            out.append(finding("invalid", c, "negative_values", "warning", r[f"neg{i}"],
                               f"{r[f'neg{i}']} negative values"))
    for i, c in enumerate(nums):
        if r[f"o{i}"] > 0:
            out.append(finding("invalid", c, "iqr_outliers", "warning", r[f"o{i}"],
                               f"{r[f'o{i}']} values outside the IQR fences"))
    date_cols = _named(cols, TIME_HINTS)
    st = parse_status(df, [c for c in date_cols if c not in _date_text_columns(df)])
    for c, (fmt, parsed, present) in formats_from(r, _date_text_columns(df)).items():
        st[c] = (parsed == present, fmt, present - parsed)
    for c in date_cols:
        ok, _, failing = st[c]
        if not ok and failing is None:
            continue                # a number named like a time is no date (same rule as the candidates, R11)
        if ok:
            out.append(finding("invalid", c, "date_parse", "success", 0, "all values parse as dates"))
        else:
            out.append(finding("invalid", c, "date_parse", "warning", failing,
                               "values that do not parse as dates"))

    # 4. consistency of text columns
    if not cats:
        out.append(finding("consistency", None, "categorical_columns", "info", None,
                           "no categorical columns"))
    for i, c in enumerate(cats):
        if r[f"w{i}"] > 0:
            out.append(finding("consistency", c, "whitespace", "warning", r[f"w{i}"],
                               f"example: {r[f'we{i}']!r}"))
        if collisions.get(c, 0) > 0:
            out.append(finding("consistency", c, "case_collisions", "warning", collisions[c],
                               "values differing only by case"))
        nu = stats.get(c, (0, 0))[0]
        if nu > 50:
            out.append(finding("consistency", c, "cardinality", "info", nu, "high cardinality"))
        elif nu == 1:
            out.append(finding("consistency", c, "cardinality", "info", nu, "single value"))
        elif nu > moderate_top:
            out.append(finding("consistency", c, "cardinality", "info", nu,
                               f"{nu - moderate_top} more beyond the top {moderate_top}"))
    return out


def audit_report(df: DataFrame, **kw) -> DataFrame:
    return findings_frame(df.sparkSession, audit_findings(df, **kw))
