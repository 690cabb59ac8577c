"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level. On each level runs of one
symbol are merged, deterministic coin tossing (the lowest bit in which a symbol
differs from its neighbour, and that bit) shrinks the symbols to six labels, and
phrases begin at the labels' local maxima. A phrase is named by a hash of its
symbols; the names are the symbols of the next level, until one is left. Where a
phrase begins depends on a few neighbours only, so equal substrings have equal
names inside, wherever they stand.

The fingerprint is the last name (16 hex digits) and 64 registers of 16 bits (hex)
over the names of all phrases of all levels. Likeness compares
registers; equal texts have equal fingerprints, likeness 1.

Rows: a null text counts as empty; the empty text's fingerprint is all zeros and
is like another empty text only. Null ids come first in the order of ids, rows
that repeat an id are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import NULL_ID, id_bounds, ship, shuffle_parts
from .minhash import REGISTERS, jaccard_estimate, registers

EMPTY = "0" * (16 + 4 * REGISTERS)

_FIRST = textvec._splitmix(256, 11)            # names of the bytes
_LOW = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin-tossing labels below 6 of symbols whose neighbours differ; ``first`` marks where texts begin."""
    if x.dtype != np.uint8:
        d = np.empty_like(x)
        d[0] = 1
        np.bitwise_xor(x[1:], x[:-1], out=d[1:])
        d[first] = 1
        k = np.frexp((d & (~d + np.uint64(1))).astype(np.float64))[1] - 1
        x = (2 * k.astype(np.uint64) + ((x >> k.astype(np.uint64)) & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        d = np.empty_like(x)
        d[0] = 1
        np.bitwise_xor(x[1:], x[:-1], out=d[1:])
        d[first] = 1
        k = _LOW[d]
        x = 2 * k + ((x >> k) & 1)
    return x


def _level(names: np.ndarray, coins: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and text offsets of the phrases of one level (no text is empty)."""
    n = len(names)
    head = np.zeros(n, dtype=bool)
    head[off[:-1]] = True
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)                                   # runs of one symbol
    if len(at) < n:
        size = np.diff(np.append(at, n)).astype(np.uint64)
        own = names[at]
        names = np.where(size > 1, textvec.mix(own + size * np.uint64(0x9E3779B97F4A7C15)), own)
        coins = coins[at]
        head = head[at]
    first = np.flatnonzero(head)
    label = _labels(coins, first).astype(np.int8)
    up = np.empty(len(label), dtype=bool)                       # greater than the one before
    up[0] = False
    np.greater(label[1:], label[:-1], out=up[1:])
    up[first] = False
    start = up.copy()
    start[:-1] &= ~up[1:] & ~head[1:]                          # a peak, not the last symbol of its text
    start[-1] = False
    start[first] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(names))
    pw, inv = textvec._powers(len(names) + 1)
    total = np.empty(len(names) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(names * pw[:len(names)], out=total[1:])
    out = textvec.mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
    return out, np.append(np.searchsorted(s, first), len(s))


def _slice_fingerprints(raw: np.ndarray, off: np.ndarray) -> list[str]:
    size = np.diff(off)
    full = np.flatnonzero(size > 0)
    out = [EMPTY] * len(size)
    if not len(full):
        return out
    coins = raw[off[0]:off[-1]]
    names, at = _FIRST[coins], np.append(off[:-1][full], off[-1]) - off[0]
    docs, last = np.arange(len(full)), np.zeros(len(full), dtype=np.uint64)
    kept, owner = [], []
    while len(docs):
        done = np.diff(at) == 1                                # one symbol is left: the text's last name
        if done.any():
            last[docs[done]] = names[at[:-1][done]]
            if done.all():
                break
            more = np.repeat(~done, np.diff(at))
            names, coins = names[more], coins[more]
            docs, at = docs[~done], np.append(0, np.cumsum(np.diff(at)[~done]))
        names, at = _level(names, coins, at)
        coins = names
        kept.append(names)
        owner.append(np.repeat(docs, np.diff(at)))
    kept.append(textvec.mix(last ^ np.uint64(1)))              # of the last name, so that no set is empty
    owner.append(np.arange(len(full)))
    kept, owner = np.concatenate(kept), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    kept, cut = kept[order], np.searchsorted(owner[order], np.arange(len(full) + 1))
    for i, d in enumerate(full):
        own = kept[cut[i]:cut[i + 1]]
        out[d] = f"{int(last[i]):016x}" + registers(np.sort(own)).astype("<u2").tobytes().hex()
    return out


def fingerprints(texts: pa.Array) -> list[str]:
    """Fingerprint of each text of an Arrow string array (null: empty)."""
    raw, off = textvec.flat(texts)
    out: list[str] = []
    for i, j in textvec.doc_slices(off):
        out += _slice_fingerprints(raw, off[i:j + 1])
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness 0 to 1 of fingerprints pairwise."""
    regs = [np.frombuffer(bytes.fromhex("".join(x[16:] for x in side)), dtype="<u2").reshape(len(side), REGISTERS)
            for side in (a, b)]
    same = np.array([x == y for x, y in zip(a, b)], dtype=bool)
    empty = np.array([x == EMPTY or y == EMPTY for x, y in zip(a, b)], dtype=bool)
    return np.where(same, 1.0, np.where(empty, 0.0, np.minimum(jaccard_estimate(*regs), 1.0)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole ``text``."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t or "") for t in texts.to_pylist()], type=pa.int64()),
                 pa.array(fingerprints(texts), type=pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the
    first as many of the next document in order of ids (after the last: the first).
    Documents are dealt to id ranges whose bounds are ids of the table; the first
    document of a range also goes to the end of the range before it, so the text
    moves once and every range finds the next document on its own.
    """
    spark = docs.sparkSession
    ship(spark)
    bounds = np.array(id_bounds(docs, buckets or 4 * shuffle_parts(spark)), dtype=np.int64)
    low = docs.agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["bucket", "guest", "key", "doc_id", "text", "fingerprint"]

    def deal(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            bucket = np.searchsorted(bounds, key, side="right").astype(np.int32)
            host = np.full(len(key), -1, dtype=np.int32)          # range that the document visits as a guest
            host[key == low] = len(bounds)
            if len(bounds):
                opens = bounds[np.maximum(bucket - 1, 0)] == key
                host[opens & (bucket > 0)] = bucket[opens & (bucket > 0)] - 1
            own = pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(np.zeros(len(key), dtype=bool)), b.column("key"), b.column("doc_id"),
                 b.column("text"), pa.array(fingerprints(b.column("text")), type=pa.string())], names=names)
            yield own
            visit = np.flatnonzero(host >= 0)
            if len(visit):
                part = own.take(pa.array(visit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host[visit]), pa.array(np.ones(len(visit), dtype=bool)), *part.columns[2:]], names=names)

    dealt = rows.mapInArrow(deal, "bucket int, guest boolean, key long, doc_id long, text string, fingerprint string")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "text")
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pair(batches):
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = []
                for r in batch.slice(at, 512).select(["bucket", "guest", "doc_id", "text", "fingerprint"]).to_pylist():
                    if last is not None and last["bucket"] == r["bucket"] and not last["guest"]:
                        found.append((last, r["text"], r["fingerprint"]))
                    last = r
                if not found:
                    continue
                edited, own, follow = [], [], []
                for r, text, _ in found:
                    n = len(r["text"])
                    edited.append(r["text"][:n - n // 2] + text[:n // 2])
                own, follow = [r["fingerprint"] for r, _, _ in found], [x for _, _, x in found]
                other = fingerprints(pa.array(edited, type=pa.large_string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["doc_id"] for r, _, _ in found], type=pa.int64()),
                    pa.array([len(r["text"]) for r, _, _ in found], type=pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
                    pa.array(own), pa.array(other), pa.array(likeness(own, other)), pa.array(likeness(own, follow))],
                    names=result)

    return dealt.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")
