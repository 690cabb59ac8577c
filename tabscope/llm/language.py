"""Language identification by prediction by partial matching.

Per language, byte contexts of up to three bytes hold how often each byte
followed (method C: a context that saw ``q`` different bytes among ``n`` escapes
with probability ``q / (n + q)`` to the context one byte shorter, at last to 256
equal bytes). The counts are frozen after training and compiled into one table
of code lengths per (longest known context, byte, language), in fixed point, so
a text's code length is an exact sum over all of its bytes. The language with
the shortest code wins; the score is its share of the posterior under equal
priors.

Training takes labelled rows only: of each language about ``sample`` documents
chosen by a hash of the id, whole texts. Counts are summed by Spark.

Rows: null texts and texts without a letter are ``und`` with score 0; so is
every text when nothing could be learned. Ties go to the first language name.
Repeated rows give repeated results; a null ``doc_id`` is never learned from and
not held out. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import released, ship

ORDER = 3
#: Training bound: documents per language.
SAMPLE = 500
#: Contexts seen less often than this are left out of the tree.
MIN_COUNT = 4
#: Code lengths are kept in units of 2^-16 bits.
UNIT = 1 << 16
#: Bits per byte from which a text is taken to be in no learned language.
MAX_BITS = 6.0

#: Bytes as the models see them: A-Z folded, digits alike, white space and controls alike.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[:33] = 32
PAD = 32


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _folded(raw: np.ndarray, off: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """The folded bytes a..b of ``raw`` and the one, two and three bytes before each, texts kept apart."""
    lo = max(a - ORDER, int(off[0]))
    own = FOLD[raw[lo:b]]
    starts = off[:-1][(off[:-1] >= a) & (off[:-1] < b)] - a
    out = [own[a - lo:]]
    for d in range(1, ORDER + 1):
        before = np.full(b - a, PAD, dtype=np.uint8)
        have = min(d, a - lo)
        if b - a > d - have:
            before[d - have:] = own[a - lo - have:len(own) - d]
        for j in range(d):
            at = starts + j
            before[at[at < b - a]] = PAD
        out.append(before)
    return out


def _count_grams(batches):
    """Partial counts of (language, context length, context, byte)."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        raw, off = textvec.flat(batch.column("text"))
        for name in sorted(set(langs)):
            rows = [i for i, x in enumerate(langs) if x == name]
            keys = []
            for i in rows:
                for a in range(int(off[i]), int(off[i + 1]), textvec.SLICE):
                    b = min(a + textvec.SLICE, int(off[i + 1]))
                    s = [x.astype(np.int64) for x in _folded(raw, off[i:i + 2], a, b)]
                    keys.append(((s[3] << 8 | s[2]) << 8 | s[1]) << 8 | s[0])
            if not keys:
                continue
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Compiled context trees: ``state[c3, c2, c1]`` and ``cost[language][state, byte]``."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        seen = np.zeros(256, dtype=bool)
        for g in grams:
            for s in range(0, 32, 8):
                seen[(g >> s) & 255] = True
        seen[PAD] = True
        size = int(seen.sum()) + 1
        self.code = np.full(256, size - 1, dtype=np.int32)       # unseen bytes share the last code
        self.code[seen] = np.arange(size - 1)
        self.size = size
        rows = []
        for g, n in zip(grams, counts):
            s = [self.code[(g >> (8 * d)) & 255].astype(np.int64) for d in range(4)]
            rows.append((s, n))
        levels, states = [], 1
        rows_of = np.zeros(1, dtype=np.int64)      # from a context to its row, else the row of its longest known suffix
        for d in range(ORDER + 1):
            key = [sum((s[j + 1] * size ** j for j in range(d)), np.zeros(len(n), np.int64)) for s, n in rows]
            if d == 0:
                kept = shorter = np.zeros(1, dtype=np.int64)
            else:
                every, at = np.unique(np.concatenate(key), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([n for _, n in rows]))
                kept = every[total >= MIN_COUNT]
                shorter = rows_of[kept % size ** (d - 1)]
                rows_of = np.tile(rows_of, size)
                rows_of[kept] = states + np.arange(len(kept))
                states += len(kept)
            levels.append((key, kept, shorter))
        self.state = rows_of.astype(np.int32)
        # one language at a time, so that a single table of floats is held beside the compiled ones
        self.cost = [self._costs(s[0], n, [(key[i], *x) for key, *x in levels]) for i, (s, n) in enumerate(rows)]

    def _costs(self, byte: np.ndarray, n: np.ndarray, levels: list) -> np.ndarray:
        """Code lengths of one language: a row per state, a column per byte."""
        size, cost = self.size, np.empty((0, self.size))
        for d, (key, kept, shorter) in enumerate(levels):
            at = np.searchsorted(kept, key)
            at[at == len(kept)] = 0
            ok = kept[at] == key if len(kept) else np.zeros(len(key), dtype=bool)
            table = np.bincount(at[ok] * size + byte[ok], weights=n[ok], minlength=len(kept) * size)
            table = table.reshape(len(kept), size)
            n_all, q = table.sum(1), (table > 0).sum(1)
            back = np.full((len(kept), size), 8.0) if d == 0 else cost[shorter]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = -np.log2(table / (n_all + q)[:, None])
                esc = -np.log2(q / (n_all + q))
            esc = np.where(n_all > 0, esc, 0.0)[:, None] + back
            cost = np.concatenate([cost, np.where(table > 0, np.nan_to_num(hit, posinf=0.0), esc)])
        return np.rint(cost * UNIT).astype(np.int32).ravel()

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in units of each text (rows) under each language (columns)."""
        out = np.zeros((len(off) - 1, len(self.langs)), dtype=np.int64)
        for i, j in textvec.doc_slices(off):
            for a in range(int(off[i]), int(off[j]), 2 * textvec.SLICE):
                b = min(a + 2 * textvec.SLICE, int(off[j]))
                s0, s1, s2, s3 = (self.code[x] for x in _folded(raw, off[i:j + 1], a, b))
                at = self.state[(s3 * self.size + s2) * self.size + s1] * np.int32(self.size) + s0
                cut = np.clip(off[i:j + 1] - a, 0, b - a)
                full = np.flatnonzero(cut[1:] > cut[:-1])
                for k, cost in enumerate(self.cost):
                    out[i + full, k] += np.add.reduceat(cost[at], cut[full], dtype=np.int64)
        return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``; None if no labelled text is there."""
    ship(docs.sparkSession)
    usable = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang")).filter(
        "lang is not null and text is not null and doc_id is not null").filter(fold_of(F.col("doc_id")) != 2)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    scale = 1 << 20
    limit = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(scale, -(-scale * sample // n)))])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(scale)) < limit[F.col("lang")])
    counts = chosen.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")).toArrow()           # bounded by the training sample
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return None
    name = np.array(counts.column("lang").to_pylist(), dtype=object)
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(gram, kind="stable")
    name, gram, n = name[order], gram[order], n[order]
    return Model(langs, [gram[name == x] for x in langs], [n[name == x] for x in langs])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every whole ``text``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column("text")
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            count = len(texts)
            if m is None:
                pred, score, bits = ["und"] * count, np.zeros(count), np.zeros(count)
            else:
                raw, off = textvec.flat(texts)
                total = m.lengths(raw, off)
                best = total.argmin(axis=1)
                least = total[np.arange(count), best]
                gap = (total - least[:, None]) / UNIT
                score = np.where(known, 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1), 0.0)
                bits = least / UNIT / np.maximum(np.diff(off), 1)
                pred = [m.langs[i] if k else "und" for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, type=pa.string()),
                 pa.array(score, type=pa.float64()), pa.array(bits, type=pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model | None, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` in a learned language: a letter, and at most ``max_bits`` per byte."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column("text")
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m is not None:
                raw, off = textvec.flat(texts)
                bits = m.lengths(raw, off).min(axis=1) / UNIT / np.maximum(np.diff(off), 1)
                known = known & (bits <= max_bits)
            yield batch.filter(pa.array(known))

    return docs.mapInArrow(released(run), docs.schema)
