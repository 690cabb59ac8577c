"""Column profiling.

Statistics for many columns are fused into one aggregation per table (split
into chunks that stay inside generated code); value counts for many columns
share one shuffle (rows are unpivoted to ``(column, value)`` and counted once,
with map-side partial aggregation, so a hot value is pre-aggregated before it
is shuffled). Results are small long-form DataFrames made from the aggregate row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import agg_row
from ..functions.distinct import estimates
from ..functions.missing import is_missing, missing_safe, normalize_missing, quote
from ..functions.stats import (kurt_bias_corrected, quantile_map, quantiles,
                               skew_bias_corrected, with_k2)
from ..functions.typeclass import (DATETIME_TYPES, NESTED_TYPES, categorical_columns,
                                   is_numeric_type, numeric_columns)


def _col(name: str) -> Column:
    return F.col(quote(name))


def value_key(df: DataFrame, name: str) -> Column:
    """A string key per value with pandas' equality (−0.0 equals 0.0)."""
    dt = df.schema[name].dataType
    col = missing_safe(df, name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        col = col + F.lit(0.0)
    return col.cast("string")


# ------------------------------------------------------------------ missing

def missing_summary(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Per column: missing count and % of rows (A1); only columns with any by default."""
    cols = df.columns
    r = agg_row(df, [("_n", F.count(F.lit(1)), 1)] +
                [(f"m{i}", F.count_if(is_missing(df, c)), 1) for i, c in enumerate(cols)])
    n = r["_n"]
    rows = [(i, c, r[f"m{i}"], (r[f"m{i}"] * 100.0 / n) if n else None) for i, c in enumerate(cols)
            if r[f"m{i}"] > 0 or not only_missing]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, missing_count bigint, missing_pct double")


def columns_with_missing(df: DataFrame) -> DataFrame:
    """Names of the columns with at least one missing value."""
    return missing_summary(df).select("position", "column_name")


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per missing-value pattern (A2a): '1' = missing, one character per column."""
    mask = F.concat(*[F.when(is_missing(df, c), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])
    return (df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("missing_columns", F.length(F.regexp_replace("pattern", "0", ""))))


def _order_number(df: DataFrame, col: str) -> Column:
    """A numeric column as it is, a date or time as microseconds since 1970."""
    if not isinstance(df.schema[col].dataType, DATETIME_TYPES):
        return _col(col)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(df.schema[col].dataType), _col(col))


def missing_bands(df: DataFrame, order_col: str, bands: int = 10) -> DataFrame:
    """Missing rate per column per block of rows along ``order_col``.

    Blocks are equal-frequency: cut points are exact quantiles of the order
    column, and a row's band is the number of cut points below its value.
    """
    cuts = [k / bands for k in range(1, bands)]
    o = _order_number(df, order_col)
    qs = quantile_map(normalize_missing(df.select(o.alias("_o"))), ["_o"], cuts)["_o"]
    band = sum((F.when(o > F.lit(q), 1).otherwise(0) for q in qs if q is not None), F.lit(0))
    cols = [c for c in df.columns if c != order_col]
    agg = (df.filter(o.isNotNull()).groupBy(band.alias("band"))
           .agg(F.count(F.lit(1)).alias("rows"),
                *[F.avg(F.when(is_missing(df, c), 1.0).otherwise(0.0)).alias(f"r{i}")
                  for i, c in enumerate(cols)]))
    return agg.select("band", "rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("missing_rate"))
        for i, c in enumerate(cols)])))


# ------------------------------------------------------------------ duplicates

def _plain(df: DataFrame) -> DataFrame:
    """``df`` with NaN as NULL and −0.0 as 0.0, the equality pandas groups by."""
    norm = normalize_missing(df)
    floats = {f.name for f in norm.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return norm.select(*[(_col(c) + F.lit(0.0).cast(norm.schema[c].dataType)).alias(c) if c in floats else _col(c)
                         for c in norm.columns])


def _row_hash(plain: DataFrame) -> list[Column]:
    """128 bits that name a row of a ``_plain`` table: two 64-bit hashes that run through
    the columns in opposite orders, NULL positions included."""
    cols = [_col(c) for c in plain.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(*cols, nulls).alias("_h1"), F.xxhash64(F.lit(31), nulls, *reversed(cols)).alias("_h2")]


def _row_groups(df: DataFrame) -> DataFrame:
    """``_k`` rows per distinct row, found by the row hash.

    The one path of all duplicate operators, whatever the rows' width: 16 bytes
    per row are shuffled, partially aggregated, so neither texts nor hot rows move."""
    plain = _plain(df)
    return plain.select(*_row_hash(plain)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_k"))


def duplicate_count_from_hashes(df: DataFrame, vc: DataFrame) -> int:
    """Duplicate-row count given a value-count table built with ``rows=True`` (same row hash)."""
    return vc.filter(F.col("column_name") == ROW_KEY).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint")).first()[0]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (A3); NULL equals NULL, −0.0 equals 0.0."""
    return _row_groups(df).agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


#: Words of 64 bits of the filter that holds the names of repeated rows: at most so many rows are broadcast.
SIEVE_WORDS = 1 << 18


def _sieved(df: DataFrame, words: int = SIEVE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(suspects, singles)``: rows whose name may be repeated, with it, and rows that surely stand alone.

    A first pass counts names (16 bytes a row, partially aggregated) and sets three bits of one
    64-bit word for each repeated one, a Bloom filter of ``words`` words at most that is broadcast
    whatever the table's size. A full filter lets rows through that stand alone; none is lost.
    The table is read once for the names and once for either part, so it must read alike each time."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftright(_h1, {6 * i}) & 63 as int))" for i in range(3))
    word, mask = F.pmod("_h2", F.lit(words)).cast("int").alias("_w"), F.expr(bits).alias("_m")
    repeated = _row_groups(df).filter("_k > 1").select(word, mask)
    sieve = F.broadcast(repeated.groupBy("_w").agg(F.bit_or("_m").alias("_bits")))
    plain = _plain(df)
    named = plain.select(*_row_hash(plain), F.struct(*[_col(c) for c in plain.columns]).alias("_row"))
    met = named.select("_h1", "_h2", "_row", word, mask).join(sieve, "_w", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_m")) == F.col("_m"), F.lit(False))
    return met.filter(hit).select("_h1", "_h2", "_row"), met.filter(~hit).select("_row.*")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row of each identical group (A4); only rows that may be repeated move."""
    suspects, singles = _sieved(df)
    kept = suspects.groupBy("_h1", "_h2").agg(F.first("_row").alias("_row")).select("_row.*")
    return singles.unionAll(kept)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every duplicated group, sorted by all columns.

    Only rows that may be repeated move; groups are counted once and re-expanded by
    their count, so no self-join."""
    suspects, _ = _sieved(df)
    g = suspects.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_k"), F.first("_row").alias("_row"))
    out = g.filter("_k > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k")))).select("_row.*")
    return out.orderBy(*[_col(c).asc_nulls_last() for c in df.columns])


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Values of ``id_col`` beyond their first occurrence (A5); missing equals missing."""
    g = df.groupBy(missing_safe(df, id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_k"))
    return g.agg(F.lit(id_col).alias("column_name"),
                 F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_ids"))


# ------------------------------------------------------------------ value counts

def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of non-missing values, most frequent first, ties by value."""
    v = missing_safe(df, col)
    return (df.filter(v.isNotNull()).groupBy(v.alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("value").asc()))


def top_values(df: DataFrame, col: str, n: int) -> list:
    """The ``n`` most frequent values (a top-k: at most ``n`` rows reach the driver)."""
    return [r[0] for r in value_counts(df, col).limit(n).collect()]


def top_category(df: DataFrame, col: str) -> DataFrame:
    """Most common value and its count."""
    return value_counts(df, col).limit(1)


def mode_value(df: DataFrame, col: str):
    """pandas ``mode()[0]``: the smallest of the most frequent values, or None."""
    r = top_values(df, col, 1)
    return r[0] if r else None


ROW_KEY = "__row__"


def row_key(df: DataFrame) -> Column:
    """The 128-bit row hash of a ``_plain`` table as text (identical rows always share it)."""
    h1, h2 = _row_hash(df)
    return F.concat_ws(":", h1.cast("string"), h2.cast("string"))


#: Texts longer than this are counted under a 128-bit name where only counts are asked for.
LONG_TEXT = 64
LONG_MARK = "\u0001"
#: Keys (about 100 bytes each) up to which their list is broadcast to look their texts up.
LOOKUP_BROADCAST = 20_000


def compact_key(text: Column) -> Column:
    """``text``, or where it is long its first ``LONG_TEXT`` characters, a mark and a 128-bit name.

    Keys are in the order of their texts, but for long texts that begin alike."""
    name = F.concat(F.left(text, F.lit(LONG_TEXT)), F.lit(LONG_MARK), F.hex(F.xxhash64(text)),
                    F.hex(F.xxhash64(F.lit(31), text)))
    return F.when(F.length(text) > LONG_TEXT, name).otherwise(text)


def is_name(key: Column) -> Column:
    """Whether a compact key stands for a long text (other keys have no character at that place)."""
    return F.substring(key, LONG_TEXT + 1, 1) == LONG_MARK


def texts_of(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """``value, text``: the long texts of ``col`` that the compact keys ``keys(value)`` stand for.

    Only rows with such a key move, once for each task and key; few keys are broadcast."""
    v = value_key(df, col)
    if keys.count() <= LOOKUP_BROADCAST:
        keys = F.broadcast(keys)
    rows = df.select(v.alias("text"), compact_key(v).alias("value")).filter(is_name(F.col("value")))
    return rows.join(keys, "value", "left_semi").groupBy("value").agg(F.min("text").alias("text"))


def top_of_each(df: DataFrame, vc: DataFrame, k: int) -> DataFrame:
    """``vc`` rows of the ``k`` most frequent values of each column with ``rank``, ties by value.

    In a compact table the order is known but for long texts that begin alike; the texts of those that may
    be among the first ``k`` are looked up, so whole texts of all other values stay where they are."""
    named = is_name(F.col("value"))
    head = F.when(named, F.left("value", F.lit(LONG_TEXT))).otherwise(F.col("value"))
    order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), head, named)
    near = vc.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k).drop("rank")
    long_ones = [r["column_name"] for r in near.filter(named).select("column_name").distinct().collect()]
    found = None
    for c in long_ones:                                # one lookup a column that has such values among its first
        keys = near.filter(named & (F.col("column_name") == c)).select("value")
        part = texts_of(df, c, keys).withColumn("column_name", F.lit(c))
        found = part if found is None else found.unionByName(part)
    if found is not None:
        near = near.join(found, ["column_name", "value"], "left").withColumn(
            "value", F.coalesce("text", "value")).drop("text").select(*vc.columns)
    last = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value"))
    return near.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def value_counts_long(df: DataFrame, cols: list[str], rows: bool = False, compact: bool = False) -> DataFrame:
    """VC core: ``(column_name, value, lower_value, count)`` for many columns with one shuffle.

    With ``rows`` the row hash is counted too (column name ``__row__``), so the
    same shuffle also counts duplicate rows. With ``compact`` long texts are
    counted under a name (see ``compact_key``), so whole texts do not move;
    counts, distinct counts and spellings that differ by case stay exact.
    ``lower_value`` names the lower-cased value the same way."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    if rows:
        plain = _plain(df)
        df = plain.withColumn(ROW_KEY, row_key(plain))

    def entry(c: str) -> Column:
        v = value_key(df, c)
        short = compact_key(v) if compact and c in texts else v
        low = F.lower(v) if c in texts else v
        return F.struct(F.lit(c).alias("column_name"), short.alias("value"),
                        (compact_key(low) if compact and c in texts else low).alias("lower_value"))
    entries = F.array(*[entry(c) for c in cols + ([ROW_KEY] if rows else [])])
    return (df.select(F.explode(entries).alias("e"))
            .filter(F.col("e.value").isNotNull())
            .groupBy("e.column_name", "e.value", "e.lower_value").agg(F.count(F.lit(1)).alias("count")))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Number of distinct non-missing values per column (A6): exact, or with ``approx`` estimated
    from one sketch a column (standard error 1.6 %, small counts exact), for which no value moves."""
    cols = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]
    if approx:
        guess, _ = estimates(df, {c: value_key(df, c) for c in cols})
        return df.sparkSession.createDataFrame([(i, c, guess[c]) for i, c in enumerate(cols)],
                                               "position int, column_name string, distinct_count bigint")
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    counted = value_counts_long(df, cols, compact=True).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"))
    present = F.array(*[F.lit(c) for c in cols])
    base = df.sparkSession.range(1).select(F.explode(present).alias("column_name"))
    return (base.join(counted, "column_name", "left")
            .select(pos[F.col("column_name")].alias("position"), "column_name",
                    F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count")))


def topn_other(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Bar-chart counts (A8): the top ``n`` values; when more values exist, the rest
    are summed into ``Other``. Largest first (so ``Other`` may lead).

    A real value ``Other`` among the top ``n`` shares that row. The top ``n`` is a
    top-k (at most ``n`` rows reach the driver); the rest is the number of present
    values, a plain count without a shuffle, minus their sum."""
    v = missing_safe(df, col)
    top = [(r["value"], r["count"]) for r in value_counts(df, col).select(
        F.col("value").cast("string").alias("value"), "count").limit(n).collect()]
    rest = df.agg(F.count(v)).first()[0] - sum(k for _, k in top)
    rows = dict(top)
    if rest:
        rows["Other"] = rows.get("Other", 0) + rest
    return df.sparkSession.createDataFrame(list(rows.items()), "value string, count bigint").orderBy(
        F.col("count").desc(), F.col("value").asc())


def pie_shares(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Pie slices (A8): ``topn_other`` with n=10 plus the percentage of the total and
    whether the slice label is shown (≥ 1 %)."""
    t = topn_other(df, col, n)            # at most n + 1 rows
    total = F.sum("count").over(Window.partitionBy())
    return (t.withColumn("pct", F.col("count") * 100.0 / total)
            .withColumn("label_shown", F.col("pct") >= 1.0))


# ------------------------------------------------------------------ numeric statistics

def numeric_report(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, sample std, min, max and missing count of one column (A11); the
    plain statistics ride along in the median's first pass (two scans in all)."""
    xs = df.select(missing_safe(df, col).cast("double").alias("x"))
    x = F.col("x")
    q = quantiles(xs, ["x"], [0.5], extra=[
        ("mean", F.avg(x), 2), ("std", F.stddev_samp(x), 3), ("min", F.min(x), 1),
        ("max", F.max(x), 1), ("missing", F.count_if(x.isNull()), 1)])
    e = q.get("__extra__") or agg_row(xs, [("mean", F.avg(x), 2), ("std", F.stddev_samp(x), 3),
                                             ("min", F.min(x), 1), ("max", F.max(x), 1),
                                             ("missing", F.count_if(x.isNull()), 1)])
    return df.sparkSession.createDataFrame(
        [(col, e["mean"], q[(None, "x", 0.5)], e["std"], e["min"], e["max"], e["missing"])],
        "column_name string, mean double, median double, std double, min double, max double, missing bigint")


def numeric_summary_all(df: DataFrame, cols: list[str] | None = None, method: str = "exact") -> DataFrame:
    """Mean, median, min, max of every numeric column (A12), long form; the plain
    statistics are one (chunked) aggregation, the medians one quantile run."""
    cols = numeric_columns(df) if cols is None else cols
    ddl = "position int, column_name string, mean double, median double, min double, max double"
    if not cols:
        return _empty(df, ddl)
    norm = normalize_missing(df.select(*[quote(c) for c in cols]))
    x = {c: _col(c).cast("double") for c in cols}
    q = quantiles(norm, cols, [0.5], method=method, extra=[e for i, c in enumerate(cols) for e in (
        (f"a{i}", F.avg(x[c]), 2), (f"lo{i}", F.min(x[c]), 1), (f"hi{i}", F.max(x[c]), 1))])
    r = q.get("__extra__") or {}
    rows = [(i, c, r.get(f"a{i}"), q[(None, c, 0.5)], r.get(f"lo{i}"), r.get(f"hi{i}"))
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, ddl)


def skew_label(skew: Column) -> Column:
    """Right / left / symmetrical at ±0.5."""
    return (F.when(skew > 0.5, F.lit("right-skewed"))
            .when(skew < -0.5, F.lit("left-skewed"))
            .when(skew.isNotNull(), F.lit("symmetrical")))


def _moment_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(position, column_name, n, g1, g2)`` — population skewness and excess
    kurtosis (NULL for a constant column) from one chunked aggregation."""
    named = []
    for i, c in enumerate(cols):
        x = missing_safe(df, c).cast("double")
        sd = F.stddev_pop(x)
        named += [(f"n{i}", F.count(x), 1), (f"sd{i}", sd, 3), (f"s{i}", F.skewness(x), 4),
                  (f"k{i}", F.kurtosis(x), 5)]
    r = agg_row(df, named)
    rows = [(i, c, r[f"n{i}"], r[f"s{i}"] if r[f"sd{i}"] else None, r[f"k{i}"] if r[f"sd{i}"] else None)
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, n bigint, g1 double, g2 double")


def skew_kurt(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness (G1) and excess kurtosis (G2) per numeric column with
    the skew label (A13–A15)."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return _empty(df, "position int, column_name string, n bigint, skewness double, kurtosis double, skew_label string")
    m = _moment_rows(df, cols)
    out = m.select("position", "column_name", "n",
                   skew_bias_corrected(F.col("n"), F.col("g1")).alias("skewness"),
                   kurt_bias_corrected(F.col("n"), F.col("g2")).alias("kurtosis"))
    return out.withColumn("skew_label", skew_label(F.col("skewness")))


def normality_test(df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """D'Agostino–Pearson K² per numeric column (A16); tested only when more than
    8 values are present, as the reference does."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return _empty(df, "position int, column_name string, n bigint, statistic double, p_value double, is_normal boolean")
    tested = with_k2(_moment_rows(df, cols), "n", "g1", "g2", "_stat", "_p")
    ok = F.col("n") > 8
    return (tested.select("position", "column_name", "n", F.when(ok, F.col("_stat")).alias("statistic"),
                          F.when(ok, F.col("_p")).alias("p_value"))
            .withColumn("is_normal", F.col("p_value") >= F.lit(alpha)))


# ------------------------------------------------------------------ categorical checks

def case_collisions(df: DataFrame, col: str) -> DataFrame:
    """Lower-cased values that have more than one spelling."""
    v = missing_safe(df, col).cast("string")
    g = df.filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("_k"))
    return (g.groupBy(F.lower("value").alias("lower_value"))
            .agg(F.count(F.lit(1)).alias("variants"), F.sum("_k").alias("rows"),
                 F.min("value").alias("first_spelling"), F.max("value").alias("last_spelling"))
            .filter(F.col("variants") > 1))


def cardinality_class(df: DataFrame, cols: list[str] | None = None, top: int = 15) -> DataFrame:
    """Distinct count per categorical column and its class (A27): high (> 50),
    constant (1), moderate (16–50, with the count beyond the top ``top`` shown)."""
    cols = categorical_columns(df) if cols is None else cols
    if not cols:
        return _empty(df, "position int, column_name string, distinct_count bigint, cardinality string, more_than_shown bigint")
    dc = distinct_counts(df, cols)
    n = F.col("distinct_count")
    return dc.select("position", "column_name", "distinct_count",
                     F.when(n > 50, F.lit("high")).when(n == 1, F.lit("constant"))
                     .when(n > top, F.lit("moderate")).alias("cardinality"),
                     F.when((n > top) & (n <= 50), n - top).alias("more_than_shown"))


def moderate_values(df: DataFrame, cols: list[str] | None = None, top: int = 15, most: int = 50) -> DataFrame:
    """The ``top`` most frequent values of each text column of moderate cardinality (A27):
    more than ``top`` and at most ``most`` distinct values; ties by value."""
    cols = categorical_columns(df) if cols is None else cols
    if not cols:
        return _empty(df, "column_name string, rank int, value string, count bigint")
    kinds = cardinality_class(df, cols, top).filter(F.col("distinct_count").between(top + 1, most))
    found = [r["column_name"] for r in kinds.collect()]              # one row per column
    if not found:
        return _empty(df, "column_name string, rank int, value string, count bigint")
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    counts = value_counts_long(df, found)                            # at most ``most`` values per column
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(
        "column_name", "rank", "value", "count")


# ------------------------------------------------------------------ time / granularity

def time_span(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """Earliest, latest and whole days between them."""
    from ..functions.dates import to_timestamp_any
    t = to_timestamp_any(df, col, fmt)
    lo, hi = F.min(t), F.max(t)
    return df.agg(F.lit(col).alias("column_name"), lo.alias("start"), hi.alias("end"),
                  F.timestamp_diff("DAY", lo, hi).alias("days"))


def granularity(df: DataFrame, id_col: str) -> DataFrame:
    """Whether each ``id_col`` value has exactly one row."""
    g = df.groupBy(missing_safe(df, id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_k"))
    agg = g.agg(F.count("_id").alias("unique_values"), F.sum("_k").alias("rows"))
    return agg.select(F.lit(id_col).alias("column_name"), "unique_values",
                      F.col("rows").cast("bigint").alias("rows"),
                      F.when(F.col("unique_values") == F.col("rows"), F.lit("one row per id"))
                      .otherwise(F.lit("several rows per id")).alias("granularity"))


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def column_modes(df: DataFrame, cols: list[str], vc: DataFrame | None = None) -> DataFrame:
    """``(column_name, mode)``: per column the smallest of the most frequent values,
    from the value-count table with two distributed aggregations (no window).

    The smallest key of a compact table tells how the mode begins; if it stands for a long text,
    the most frequent ones that begin so are looked up."""
    vc = value_counts_long(df, cols, compact=True) if vc is None else vc.filter(F.col("column_name").isin(cols))
    best = vc.groupBy("column_name").agg(F.max("count").alias("_top"))
    tied = vc.join(F.broadcast(best), "column_name").filter(F.col("count") == F.col("_top"))   # one row per column
    out = []
    for r in tied.groupBy("column_name").agg(F.min("value").alias("mode"),
                                             is_name(F.min("value")).alias("named")).collect():
        mode, c = r["mode"], r["column_name"]
        if r["named"]:
            keys = tied.filter((F.col("column_name") == c) & is_name(F.col("value"))
                               & (F.left("value", F.lit(LONG_TEXT)) == mode[:LONG_TEXT])).select("value")
            mode = texts_of(df, c, keys).agg(F.min("text")).first()[0]
        out.append((c, mode))
    return df.sparkSession.createDataFrame(out, "column_name string, mode string")


def table_summary(df: DataFrame, vc: DataFrame | None = None) -> DataFrame:
    """Per column (A10): type, distinct count, missing %, and a description —
    numeric: mean and sample std; datetime: first and last; otherwise the mode."""
    return table_summary_and_rows(df, vc)[0]


def _summary_kind(dt) -> str:
    if is_numeric_type(dt, include_bool=True):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "categorical"


def table_summary_aggregates(df: DataFrame) -> list:
    """The summary's per-column aggregates (prefixed ``_ts``); they can ride along in
    another pass over the table."""
    named = [("_tsn", F.count(F.lit(1)), 1)]
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]
    for i, f in enumerate(fields):
        x = missing_safe(df, f.name)
        named.append((f"_tsm{i}", F.count_if(x.isNull()), 1))
        kind = _summary_kind(f.dataType)
        if kind == "numeric":
            xd = x.cast("double")
            named += [(f"_tsa{i}", F.avg(xd), 2), (f"_tss{i}", F.stddev_samp(xd), 3)]
        elif kind == "datetime":
            named += [(f"_tslo{i}", F.min(x).cast("string"), 1), (f"_tshi{i}", F.max(x).cast("string"), 1)]
    return named


def table_summary_and_rows(df: DataFrame, vc: DataFrame | None = None,
                           stats: dict | None = None) -> tuple[DataFrame, int]:
    """``table_summary`` and the table's row count from the same aggregation
    (``stats``: the results of ``table_summary_aggregates`` computed elsewhere)."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]
    names = [f.name for f in fields]
    if not names:
        return (_empty(df, "position int, column_name string, data_type string, unique_values bigint, "
                           "missing_pct double, mean double, std double, mode string, description string"),
                df.count())
    kinds = {f.name: _summary_kind(f.dataType) for f in fields}
    r = stats if stats is not None and "_tsn" in stats else agg_row(df, table_summary_aggregates(df))
    n = r["_tsn"]
    rows = [(i, f.name, f.dataType.simpleString(), kinds[f.name],
             (r[f"_tsm{i}"] * 100.0 / n) if n else None, r.get(f"_tsa{i}"), r.get(f"_tss{i}"),
             r.get(f"_tslo{i}"), r.get(f"_tshi{i}")) for i, f in enumerate(fields)]
    per_col = df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, kind string, missing_pct double, "
              "mean double, std double, first string, last string")
    # one value-count shuffle serves both the distinct counts and the modes
    own = vc is None
    vc = (value_counts_long(df, names, compact=True).persist(StorageLevel.MEMORY_AND_DISK) if own
          else vc.filter(F.col("column_name").isin(names)))
    dc = {r["column_name"]: r["n"] for r in
          vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per column
    cat_cols = [c for c in names if kinds[c] == "categorical"]
    modes = {r["column_name"]: r["mode"] for r in column_modes(df, cat_cols, vc).collect()} if cat_cols else {}
    if own:
        vc.unpersist()
    out = per_col.join(df.sparkSession.createDataFrame(
        [(c, dc.get(c, 0), modes.get(c)) for c in names],
        "column_name string, unique_values bigint, mode string"), "column_name")
    desc = (F.when(F.col("kind") == "numeric",
                   F.format_string("numbers with mean %.2f and deviation %.2f", F.col("mean"), F.col("std")))
            .when(F.col("kind") == "datetime",
                  F.concat(F.lit("times between "), F.col("first"), F.lit(" and "), F.col("last")))
            .otherwise(F.concat(F.lit("values, most often "), F.coalesce(F.col("mode"), F.lit("none")))))
    return (out.select("position", "column_name", "data_type", "unique_values", "missing_pct",
                       "mean", "std", "mode", desc.alias("description")).orderBy("position"), n)
