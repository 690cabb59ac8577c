"""Near-duplicate documents with HyperMinHash registers, and exact confirmation.

1. Every text becomes its set of distinct k-word shingle hashes and 64 registers:
   the top 6 hash bits pick a bucket, the smallest remainder of a bucket is kept
   as leading-zero count plus 10 mantissa bits; empty buckets borrow from a
   non-empty one in a fixed random order.
2. Texts with equal sets form one class; only the class representative goes on,
   so thousands of copies weigh as one row.
3. Bands of registers are hashed; inside a band bucket the collision-corrected
   Jaccard estimate decides which members may be linked. Buckets too large for
   one group are joined as a whole (a superset, so nothing is lost).
4. The groups so found are confirmed on full shingle sets: a breadth-first walk
   in each group compares a visited text with the unvisited ones only. Groups
   larger than one block are walked block by block, all blocks sharing some
   pivot texts, and what then is not connected is compared with every block.
5. Components come from the confirmed links only.

Rows: a null or word-less text has no shingle and is linked with nothing. A row
with a null ``doc_id`` gets its ``n_shingles``, a null ``component_id`` and is kept.
A class is named by its smallest ``doc_id``; classes named by the same (repeated)
``doc_id`` are one node of the link graph. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import batched, connected_components, cut, drop_table, map_groups, ship, shuffle_parts

REGISTERS = 64
BUCKET_BITS = 6
MANTISSA_BITS = 10
#: Members of one band bucket that are compared by estimate; a larger bucket is joined whole.
BUCKET_LIMIT = 1024
#: Texts and shingles of one confirmation block.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
PIVOTS = 32
#: Chance that two unequal register minima still give the same register.
COLLISION = 1.0 / (3 << MANTISSA_BITS)

_ORDER: list[np.ndarray] = []


def _orders() -> np.ndarray:
    """rank[j, b]: place of bucket b in the fixed random order bucket j borrows by."""
    if not _ORDER:
        h = textvec._splitmix(REGISTERS * REGISTERS, 99).reshape(REGISTERS, REGISTERS)
        _ORDER.append(h.argsort(axis=1).argsort(axis=1))
    return _ORDER[0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The uint16 registers of one sorted non-empty shingle set."""
    shift = np.uint64(64 - BUCKET_BITS)
    edges = np.arange(REGISTERS, dtype=np.uint64) << shift
    at = np.searchsorted(shingles, edges)
    has = at < len(shingles)
    has[has] = (shingles[at[has]] >> shift) == np.flatnonzero(has).astype(np.uint64)
    rest = shingles[at[has]] & ((np.uint64(1) << shift) - np.uint64(1))
    part, exp = np.frexp((rest + np.uint64(1)).astype(np.float64))
    zeros = (64 - BUCKET_BITS + 1 - exp).astype(np.uint16)
    fine = ((part - 0.5) * (2 << MANTISSA_BITS)).astype(np.uint16)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[has] = (zeros << MANTISSA_BITS) | fine
    if not has.all():
        full = np.flatnonzero(has)
        rank = _orders()[~has][:, full]
        out[~has] = out[full[rank.argmin(axis=1)]]
    return out


def jaccard_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of register rows ``a`` (one) and ``b`` (many)."""
    same = (b == a).mean(axis=-1)
    return np.maximum(0.0, (same - COLLISION) / (1.0 - COLLISION))


def band_rows(threshold: float, miss: float = 2e-5) -> int:
    """Most registers a band may join so that a pair at the threshold is missed with chance ``miss`` at most."""
    r = 1
    while (1 - threshold ** (r + 1)) ** (REGISTERS // (r + 1)) <= miss:
        r += 1
    return r


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` (128-bit name of the set) and ``sig`` (registers) per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()),
                        ("h2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for s in textvec.text_sets(batch.column("text"), k):
                n.append(len(s))
                if len(s):
                    a, b = set_name(s)
                    h1.append(a)
                    h2.append(b)
                    sig.append(registers(s).tobytes())
                else:
                    h1.append(None)
                    h2.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(x, type=t) for x, t in
                 ((n, pa.int64()), (h1, pa.int64()), (h2, pa.int64()), (sig, pa.binary()))]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a shingle set."""
    a = int(s.sum(dtype=np.uint64))
    b = int(textvec.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


class _Union:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _likely_links(floor: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(t: pa.Table):
        """A forest over the members of a band bucket whose estimate reaches the floor."""
        ids = t.column("rep").to_numpy()
        if len(ids) < 2:
            return
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(len(ids), REGISTERS)
        todo, a, b = np.arange(len(ids)), [], []
        while len(todo):                       # walk: a visited member meets the unvisited ones only
            queue, todo = [int(todo[0])], todo[1:]
            while queue and len(todo):
                p = queue.pop()
                near = jaccard_estimate(sig[p], sig[todo]) >= floor
                hit = todo[near]
                a.extend([ids[p]] * len(hit))
                b.extend(ids[hit])
                queue.extend(hit.tolist())
                todo = todo[~near]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in (a, b)], schema=schema)

    return pairs


def _confirmed_links(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(t: pa.Table):
        """A forest over one block: its components under the exact link rule."""
        ids = t.column("rep").to_numpy()
        names = list(zip(t.column("h1").to_pylist(), t.column("h2").to_pylist()))
        fresh = t.column("fresh").to_numpy(zero_copy_only=False)
        sets, keep, seen = [], [], set()
        for i, s in enumerate(textvec.text_sets(t.column("text"), k)):
            if len(s) and names[i] not in seen and set_name(s) == names[i]:
                seen.add(names[i])
                sets.append(s)
                keep.append(i)
        if len(keep) < 2:
            return
        ids, fresh = ids[keep], fresh[keep]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(int(code.max()) + 1, dtype=np.int64)
        todo = np.ones(len(ids), dtype=bool)
        a, b = [], []
        for root in range(len(ids)):
            if not todo[root]:
                continue
            todo[root] = False
            queue = [root]
            while queue:
                p = queue.pop()
                # a pair's sizes must agree to the threshold; a pair of known members was met in its own block
                want = todo & (size * num <= size[p] * den) & (size[p] * num <= size * den)
                if not fresh[p]:
                    want &= fresh
                cand = np.flatnonzero(want)
                if not len(cand):
                    continue
                own = code[begin[p]:begin[p + 1]]
                mark[own] = 1
                if len(cand) * 3 > len(ids):
                    both = np.add.reduceat(mark[code], begin[:-1])[cand]
                else:
                    both = np.array([mark[code[begin[c]:begin[c + 1]]].sum() for c in cand])
                mark[own] = 0
                hit = cand[den * both >= num * (size[cand] + size[p] - both)]
                a.extend([ids[p]] * len(hit))
                b.extend(ids[hit])
                todo[hit] = False
                queue.extend(hit.tolist())
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in (a, b)], schema=schema)

    return pairs


def _candidate_groups(classes: DataFrame, threshold: float, keep: list[str]) -> DataFrame:
    """``(node, root)``: groups of representatives that hold every likely link."""
    r = band_rows(threshold)
    bands = REGISTERS // r
    floor = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS))
    key = F.explode(F.array(*[F.xxhash64(F.substring("sig", 2 * r * i + 1, 2 * r), F.lit(i)) for i in range(bands)]))
    rows = classes.select("rep", key.alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("first")).filter("m > 1")
    met = cut(rows.join(shared, "key"), "bands", keep)
    small = met.filter(F.col("m") <= BUCKET_LIMIT).select("key", "rep").join(classes.select("rep", "sig"), "rep")
    likely = map_groups(small, ["key"], _likely_links(floor), "a long, b long", order=["rep"])
    whole = met.filter((F.col("m") > BUCKET_LIMIT) & (F.col("rep") > F.col("first"))).select(
        F.col("first").alias("a"), F.col("rep").alias("b"))
    return connected_components(likely.unionAll(whole))


def _blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each group to blocks; pivots go to every block of their group."""
    per = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("tot"))
    k = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("tot") / BLOCK_SHINGLES)).cast("int")
    return members.join(per.select("root", "m", k.alias("k")), "root").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``den * |A ∩ B| >= num * |A ∪ B|`` for their sets of
    ``shingle``-word shingles; ``component_id`` is the smallest id reachable.
    """
    spark = docs.sparkSession
    ship(spark)
    old: list[str] = []
    base = cut(signatures(docs, shingle), "signatures")
    classes = cut(base.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "classes")
    groups = _candidate_groups(classes, num / den, old)
    members = cut(_blocks(classes.select("rep", "h1", "h2", "n_shingles").join(
        groups.select(F.col("node").alias("rep"), "root"), "rep")), "members", old)
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
                .join(members.hint("merge"), "rep"), "texts", old)     # members grow with the corpus: never broadcast

    confirm = _confirmed_links(shingle, num, den)
    cols = ["root", "block", "rep", "h1", "h2", "fresh", "text"]
    pivot = (F.col("k") > 1) & (F.pmod(F.xxhash64("rep", F.lit(1)), F.col("m")) < PIVOTS)
    dealt = texts.withColumn("fresh", F.lit(True)).withColumn("block", F.explode(
        F.when(pivot, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("block"))))
    links = cut(map_groups(dealt.select(*cols), ["root", "block"], confirm, "a long, b long", order=["rep"]),
                "links", old)
    found = cut(connected_components(links), "found", old)

    # groups of several blocks: what is outside the largest component meets every block
    few = max(1, shuffle_parts(spark) // 8)
    split = members.filter("k > 1").select("rep", F.col("root").alias("grp"), "k").join(
        found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
    sizes = split.groupBy("grp", "comp").agg(F.count("*").alias("c"))
    top = sizes.groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("t")).select("grp", F.col("t.comp").alias("comp"))
    loose = cut(split.select("rep", "grp", "k", "comp").join(top, ["grp", "comp"], "left_anti")
                .coalesce(few), "loose", old)
    if loose.limit(1).count():
        parts = loose.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("u"))
        side = loose.select("rep", "grp").join(parts, "grp").withColumn(
            "part", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("u")).cast("int"))
        moved = texts.filter("k > 1").join(side.select("rep", "part"), "rep").select(
            "root", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), "part",
            "rep", "h1", "h2", F.lit(True).alias("fresh"), "text")
        at_home = texts.filter("k > 1").join(parts.withColumnRenamed("grp", "root"), "root").select(
            "root", "block", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("part"),
            "rep", "h1", "h2", F.lit(False).alias("fresh"), "text")
        more = map_groups(moved.unionAll(at_home), ["root", "block", "part"], confirm, "a long, b long",
                          order=["fresh", "rep"])
        links = links.unionAll(more)
        found = cut(connected_components(links), "found", old)

    comp = cut(found.select(F.col("node").alias("rep"), F.col("root").alias("comp")), "components")
    named = classes.select("h1", "h2", "rep").join(comp, "rep", "left").select(
        "h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    for p in old:
        drop_table(spark, p)
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    cid = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_per_group(docs: DataFrame, **rule) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate component (smallest id).

    A document is its ``doc_id``: all rows of the id that stays are kept, and rows with a null id.
    """
    gone = near_duplicates(docs, **rule).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
