"""Benchmark passages inside documents: SimHash windows, multi-index Hamming blocks, exact confirmation.

Built-in DataFrame and SQL functions only. Words are lower-cased runs of letters
and digits; a text's shingles are its runs of five words (an item with fewer
words is one shingle).

1. A window is worth a fingerprint only if it shares a shingle with an item of
   its size: an item shingle table (broadcast while small) marks those places.
2. Around each mark every item-sized window gets a 64-bit SimHash. Its bit
   counters are packed in lanes of long integers, so a shingle costs a few adds.
3. Items are indexed by 8-bit blocks of their fingerprint and every value within
   two bits of a block: a fingerprint within the radius (23 bits) agrees with at
   least one of the eight blocks that far, so the index misses none.
4. Candidates within the radius are confirmed by the exact weighted similarity,
   shingles weighted by how often they occur: sum of minima over sum of maxima.

Rows: null or word-less texts and items match nothing; a null ``doc_id`` is kept
apart per text; rows that repeat give one result row; a document shorter than an
item is one window. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Rows of an item-side table that is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: All block values that differ from a block in two bits at most.
MASKS = [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= NEAR]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(df: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep``, the number of words ``n`` and the shingle hashes ``g`` in text order."""
    hashed = df.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    g = F.when(F.size("h") >= k, F.transform(
        F.sequence(F.lit(0), F.size("h") - k),
        lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(*keep, F.size("h").alias("n"), g.alias("g"))


def simhash(g: str, lane: int = 16) -> Column:
    """64-bit SimHash of an array column of shingle hashes (repeats count); ``lane`` bits per counter."""
    mask = sum(1 << (lane * j) for j in range(64 // lane))
    top = lane - 2
    sums = (f"aggregate({g}, array_repeat(0L, {lane}), (acc, x) -> zip_with(acc, sequence(0, {lane - 1}), "
            f"(a, i) -> a + (shiftrightunsigned(x, i) & {mask}L)))")
    over = f"({1 << top}L - 1 - cast(floor(size({g}) / 2) as bigint)) * {mask}L"
    # not nullable, so that no null filter is inferred that would compute it once more
    return F.expr(f"coalesce(aggregate(zip_with({sums}, sequence(0, {lane - 1}), (l, i) -> "
                  f"shiftleft(shiftrightunsigned(l + {over}, {top}) & {mask}L, i)), 0L, (a, x) -> a | x), 0L)")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _leaks(docs: DataFrame, items: DataFrame, k: int, most: int, rows: int, num: int, den: int) -> DataFrame:
    """Confirmed windows for items whose shingles have ``k`` words.

    Arrays are exploded with the outer form, for which no filter on the array is
    inferred: such a filter would be pushed down and build the array again.
    """
    lane = 16 if most < 1 << 14 else 32
    bench = items.select("item_id", F.col("n").alias("w"), F.col("g").alias("ig"), simhash("g", lane).alias("ifp"))
    marks = bench.select(F.explode("ig").alias("s"), "w").distinct()
    found = _shingles(docs, k, ["rk"]).select("rk", F.posexplode_outer("g").alias("pos", "s")).join(
        _sent(marks, rows), "s")
    spots = found.groupBy("rk", "w").agg(F.collect_set("pos").alias("ps")).groupBy("rk").agg(
        F.collect_list(F.struct("w", "ps")).alias("spots"))
    marked = _shingles(docs.join(spots, "rk"), k, ["rk", "doc_id", "spots"])
    sized = marked.select("rk", "doc_id", "n", "g", F.explode_outer("spots").alias("x")).select(
        "rk", "doc_id", "n", "g", F.col("x.w").alias("w"), F.col("x.ps").alias("ps"),
        F.least("x.w", "n").alias("len"))
    starts = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(
        F.greatest(F.lit(0), p - (F.col("len") - k)), F.least(p, F.col("n") - F.col("len"))))))
    windows = sized.select("rk", "doc_id", "w", "len", "g", F.explode_outer(starts).alias("start")).filter("start >= 0").select(
        "rk", "doc_id", "w", "len", "start", F.slice("g", F.col("start") + 1, F.col("len") - k + 1).alias("win"))
    prints = windows.withColumn("fp", simhash("win", lane))

    block = [F.shiftrightunsigned("fp", BLOCK_BITS * j).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for j in range(BLOCKS)]
    probes = prints.withColumn("at", F.explode(F.array(*[
        F.struct(F.lit(j).alias("block"), b.cast("int").alias("value")) for j, b in enumerate(block)])))
    probes = probes.select("rk", "doc_id", "w", "len", "start", "win", "fp", "at.block", "at.value")
    index = bench.select("item_id", "w", "ig", "ifp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    value = F.expr(f"cast(shiftrightunsigned(ifp, {BLOCK_BITS} * block) & {(1 << BLOCK_BITS) - 1} as int)")
    index = index.select("item_id", "w", "ifp", "block", F.explode(F.transform(
        F.lit(MASKS), lambda m: m.bitwiseXOR(value))).alias("value"))
    near = probes.join(_sent(index, rows * len(MASKS) * BLOCKS), ["w", "block", "value"])
    diff = F.col("fp").bitwiseXOR(F.col("ifp"))
    # a pair that agrees in several blocks is taken at the first of them
    first = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(diff, BLOCK_BITS * j).bitwiseAND(
        F.lit((1 << BLOCK_BITS) - 1))) <= NEAR, F.lit(j)) for j in range(BLOCKS)])
    near = near.filter((F.bit_count(diff) <= RADIUS) & (F.col("block") == first))

    pairs = near.select("rk", "doc_id", "item_id", "start", "len", "win", F.bit_count(diff).alias("hamming")).join(
        _sent(bench.select("item_id", "ig"), rows), "item_id")
    plain = (F.size(F.array_distinct("win")) == F.size("win")) & (F.size(F.array_distinct("ig")) == F.size("ig"))
    counted = F.expr("aggregate(array_distinct(ig), 0, (a, x) -> a + least(size(filter(win, y -> y = x)), "
                     "size(filter(ig, y -> y = x))))")
    both = F.when(plain, F.size(F.array_intersect("win", "ig"))).otherwise(counted)
    pairs = pairs.withColumn("both", both).withColumn("all", F.size("win") + F.size("ig") - F.col("both"))
    return pairs.filter(den * F.col("both") >= num * F.col("all")).select(
        "rk", "doc_id", "item_id", "start", F.col("len").alias("n_words"), "hamming",
        (F.col("both") / F.col("all")).alias("similarity"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64("doc_id", text).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"))


def _find(docs: DataFrame, benchmark: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sizes = items.select(F.size(words(F.col("text"))).alias("n")).filter("n > 0").groupBy(
        F.least("n", F.lit(shingle)).alias("k")).agg(
        F.sum("n").alias("total"), F.max("n").alias("most")).collect()       # at most ``shingle`` rows
    out = None
    for r in sorted(sizes):
        own = cut(_shingles(items, r["k"], ["item_id"]), "items").filter(
            F.least("n", F.lit(shingle)) == r["k"])
        part = _leaks(docs, own, r["k"], r["most"], r["total"], num, den)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.limit(0).selectExpr("rk", "doc_id", "0L item_id", "0 start", "0 n_words", "0 hamming",
                                       "0d similarity")
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, item_id, start, n_words, hamming, similarity``: the best window of each document for each item.

    ``start`` counts words from 0; of equally similar windows the first is given.
    """
    best = F.max(F.struct("similarity", -F.col("start"), -F.col("n_words"), -F.col("hamming"))).alias("b")
    return _find(_keyed(docs), benchmark, shingle, num, den).groupBy("rk", "doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("start"), (-F.col("b.col3")).alias("n_words"),
        (-F.col("b.col4")).alias("hamming"), F.col("b.similarity").alias("similarity"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage.

    A row is known by its ``doc_id`` and a hash of id and text, so no other document goes with it."""
    taken = {c.lower() for c in docs.columns}
    key, own = "_row_key", "_row_id"
    while key in taken or own in taken:
        key, own = key + "_", own + "_"
    leaks = _find(_keyed(docs), benchmark, shingle, num, den).select(
        F.col("rk").alias(key), F.col("doc_id").alias(own)).distinct()
    keyed = docs.withColumns({key: F.xxhash64("doc_id", F.col("text").cast("string")),
                              own: F.col("doc_id").cast("long")})
    same = (keyed[key] == leaks[key]) & keyed[own].eqNullSafe(leaks[own])
    return keyed.join(leaks, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
