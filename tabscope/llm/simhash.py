"""Near-duplicate documents by SimHash fingerprints, joined by meet-in-the-middle ball hashing.

1. A text's fingerprint has a bit set where over half of the XXH64 values of its
   word shingles (repeats included) have it set.
2. Equal fingerprints are one node. Fingerprints at distance 3 or less have a
   middle point: one that lies within 2 bits of the first and within 1 bit of
   the second. Every fingerprint emits all variants within those distances.
3. Variants meet by their leading bits: those of one fingerprint that share the
   leading bits travel as one row and are expanded where they meet, so a row
   stands for up to 2,081 variants. The number of leading bits follows the
   number of fingerprints; a prefix that stays crowded is cut by further bits.
4. Where variants collide the pair is checked by its distance. A variant's
   members all lie within 2 bits of one fingerprint that is within 1 bit of it,
   so they are tied to that one instead of to one another: ties grow with the
   fingerprints, not with pairs.
5. Components of the ties give each document its class.

Rows: a null, empty or blank text has fingerprint zero, which is linked like any
other. A row with a null ``doc_id`` gets its fingerprint, a null ``component_id``
and ties nothing. Repeated rows and ids are nodes by their fingerprint: a
``doc_id`` with two texts belongs to both classes and every row names its own
text's class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_table, map_groups, ship

RADIUS = 3
SEED = 42
#: Rows that a prefix holds on average, and from which on it is cut by further bits.
GROUP_ROWS = 16_384
CROWDED = 8 * GROUP_ROWS
#: Bits by which a crowded prefix is cut.
STEP_BITS = 6
#: Variants expanded at once, and hashes whose bits are counted at once.
CHUNK = 1 << 20
#: Crowded prefixes (16 bytes each) up to which their list is broadcast.
HOT_BROADCAST = 100_000


def _hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text (fewer words: of the whole sequence)."""
    words = text.lower().split()                      # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:len(words) - size] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())),
                       dtype=np.uint64, count=len(starts))


def simhash(text: str | bytes | None, k: int = 3) -> int:
    """Fingerprint of one whole text: a bit is 1 if set in over half of the hashes."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    h = _hashes(raw, k)
    if not len(h):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole ``text``."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = np.array([simhash(t, k) for t in b.column("text").cast(pa.large_binary()).to_pylist()],
                             dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))],
                                             names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=None)
def flips(bits: int, most: int) -> np.ndarray:
    """Masks of up to ``most`` set bits among the lowest ``bits``."""
    return np.array([sum(1 << i for i in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)],
                    dtype=np.uint64)


def prefix_bits(n: int) -> int:
    """Fewest leading bits by which ``n`` fingerprints fall into groups of ``GROUP_ROWS`` rows on average."""
    bits = 0
    while n * (1 + bits + bits * (bits - 1) // 2) > GROUP_ROWS << bits and bits < 60:
        bits += 1
    return bits


def _explode_flips(bits: int, spent: Column) -> Column:
    """Masks over ``bits`` bits that keep the distance within the larger half of the radius."""
    half = (RADIUS + 1) // 2
    masks = [F.lit(flips(bits, half - used).astype(np.int64)) for used in range(half + 1)]
    out = F.when(spent == 0, masks[0])
    for used in range(1, half + 1):
        out = out.when(spent == used, masks[used])
    return F.explode(out)


def meeting_rows(fps: DataFrame, n: int, old: list[str]) -> DataFrame:
    """``bits, prefix, fp``: each fingerprint under every prefix that one of its variants has."""
    bits = prefix_bits(n)
    own = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    rows = fps.select("fp", _explode_flips(bits, F.lit(0)).alias("mask")).select(
        F.lit(bits).alias("bits"), own.bitwiseXOR(F.col("mask")).alias("prefix"), "fp")
    done = None
    while bits < 60:                                   # 60 leading bits leave 16 fingerprints to a prefix
        crowded = cut(rows.groupBy("bits", "prefix").count().filter(F.col("count") > CROWDED).select("prefix"),
                      "crowded", old)
        many = crowded.count()
        if not many:
            break
        if many <= HOT_BROADCAST:
            crowded = F.broadcast(crowded)
        calm = rows.join(crowded, "prefix", "left_anti").select("bits", "prefix", "fp")
        done = calm if done is None else done.unionAll(calm)
        step = min(STEP_BITS, 60 - bits)
        own = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
        spent = F.bit_count(own.bitwiseXOR(F.col("prefix")))
        more = F.shiftrightunsigned("fp", 64 - bits - step).bitwiseAND(F.lit((1 << step) - 1))
        rows = cut(rows.join(crowded, "prefix", "left_semi").select(
            "prefix", "fp", _explode_flips(step, spent).alias("mask")).select(
            F.lit(bits + step).alias("bits"),
            F.shiftleft("prefix", step).bitwiseOR(more.bitwiseXOR(F.col("mask"))).alias("prefix"), "fp"),
            "crowded_rows", old)
        bits += step
    return rows if done is None else done.unionAll(rows)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member reachable of each of ``n`` members over the ties ``a``-``b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _collisions(fp: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tied members (a, b) of one prefix: their variants under it collide and their distance is within the radius."""
    rest = 64 - bits
    spent = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(prefix)) if bits else np.zeros(len(fp), np.uint8)
    low = fp & np.uint64((1 << rest) - 1)
    near, far = RADIUS // 2, (RADIUS + 1) // 2
    values, owners = [], []
    for used in range(near + 1):
        at = np.flatnonzero(spent == used)
        masks = flips(rest, near - used)
        values.append((low[at][:, None] ^ masks).ravel())
        owners.append(np.repeat(at, len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    if not len(values):
        return owners, owners
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    head = owners[np.flatnonzero(new)]                             # the fingerprint that a variant's members are tied to
    pairs = [_packed(owners, head[np.cumsum(new) - 1], len(fp))]
    values = values[new]
    bell = max(10, int(16 * len(values)).bit_length())
    seen = np.zeros(1 << bell, dtype=bool)                         # most variants meet none: asked before the search
    place = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bell)
    seen[place(values)] = True
    for used in range(far + 1):
        at = np.flatnonzero(spent == used)
        masks = flips(rest, far - used)
        step = max(1, CHUNK // len(masks))
        for i in range(0, len(at), step):
            var = (low[at[i:i + step]][:, None] ^ masks).ravel()
            maybe = np.flatnonzero(seen[place(var)])
            found = np.searchsorted(values, var[maybe])
            found[found == len(values)] = 0
            hit = values[found] == var[maybe]
            pairs.append(_packed(at[i + maybe[hit] // len(masks)], head[found[hit]], len(fp)))
    pairs = np.unique(np.concatenate(pairs))
    a, b = pairs // len(fp), pairs % len(fp)
    near_enough = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    return a[near_enough], b[near_enough]


def _packed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Distinct unequal pairs as ``a * n + b``."""
    apart = a != b
    return np.unique(a[apart] * n + b[apart])


def _ties(t: pa.Table):
    """A forest of ties over the fingerprints of one prefix."""
    fp = t.column("fp").to_numpy().view(np.uint64)
    a, b = _collisions(fp, t.column("prefix")[0].as_py(), t.column("bits")[0].as_py())
    if len(a):
        label = _settle(len(fp), a, b)
        tied = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[tied]), pa.array(signed[label[tied]])], names=["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) per row of ``docs``.

    Two documents are linked when the SimHash fingerprints over their ``k``-word
    shingles differ in ``RADIUS`` bits or fewer.
    """
    spark = docs.sparkSession
    old: list[str] = []
    base = cut(fingerprints(docs, k), "simhashes")
    nodes = cut(base.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    rows = meeting_rows(nodes.select("fp"), nodes.count(), old)
    ties = cut(map_groups(rows, ["bits", "prefix"], _ties, "a long, b long", order=["fp"]), "ties", old)
    tied = cut(connected_components(ties).withColumnRenamed("node", "fp").join(nodes, "fp"), "tied", old)
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    classes = cut(tied.select("fp", "root").join(least, "root").select("fp", "least"), "classes")
    for path in old:
        drop_table(spark, path)
    named = nodes.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return base.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
