"""Document quality from weak labels.

Two questions are answered for every document: is it junk, and is it abusive.
For each, overlapping heuristic labellers vote bad, good or nothing; where a
table of labels is given, its sparse labels are one more labeller.

1. Votes of all documents are counted by pattern (at most 3^labellers rows).
2. Expectation-maximisation on the pattern counts estimates how often each
   labeller gives each vote for good and for bad documents, and so the
   posterior of every pattern.
3. A bounded sample of documents (labelled ones if there are any) with these
   posteriors trains a hashed linear scorer per question: shares of hashed word
   shapes for junk; hashed words and word beginnings for abuse, with an L1 penalty
   that leaves few weights.
4. The scorers judge every whole text.

Rows: a null or word-less text has ``p_junk`` 1 and is not kept; rows are judged
one by one, so repeats give equal results; a null ``doc_id`` has no label. Without
votes for both classes nothing is rejected but empty texts. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import released, ship

#: Training bound: rows of the scorers' sample.
SAMPLE = 4000
#: Hash space of the abuse scorer's features (word beginnings of these lengths, and words).
FEATURE_BITS = 40
BEGINNINGS = (4, 5, 6)
SHAPES = 1 << 12
#: A feature is a candidate weight when this many bad sample documents have it.
MIN_SUPPORT = 4
CANDIDATES = 1500

#: Insults and words of contempt that two of the labellers look for.
INSULTS = ("idiot", "loser", "moron", "clown", "scum", "fool", "jerk", "imbecile")
CONTEMPT = ("pathetic", "worthless", "disgusting", "stupid", "trash", "dumb", "ugly", "garbage")
#: Frequent short words of some languages; running text has them.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "der", "die", "das", "und", "den", "zu",
                  "le", "la", "les", "de", "et", "un", "en", "est", "el", "los", "las", "y", "que", "del")

#: Largest share of good documents that a labeller may call bad.
FALSE_ALARM = 0.001

#: A document is rejected from these chances on; an abusive word is missed more often than seen wrongly.
JUNK_CUT, ABUSE_CUT = 0.5, 0.25

JUNK = ("repeats", "symbols", "capitals", "endings", "function_words", "label")
ABUSE = ("insults", "contempt", "label")


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.sort(textvec.Words(raw, np.array([0, len(raw)]), textvec.MARK).hashes())


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), dtype=bool)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in ".,;:'\"()-"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _POINT | textvec.SPACE)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


@dataclass
class Features:
    """Per text: ``n`` words, the labellers' measures, shape shares; and the abuse features of all words."""
    n: np.ndarray
    counts: np.ndarray            # repeats, symbols, capitals, endings, function words; insults, contempt
    whole: np.ndarray             # what the first five are shares of: words, bytes, letters, words, tokens
    shapes: np.ndarray            # texts x SHAPES counts, as (text, shape, count) triples
    owner: np.ndarray             # text of each abuse feature
    feature: np.ndarray
    last: np.ndarray              # hash of the slice's last word, if it has one

    @property
    def measures(self) -> np.ndarray:
        """Share of repeats, symbols, capitals, endings, function words; insults, contempt."""
        return np.concatenate([self.counts[:, :5] / np.maximum(self.whole, 1), self.counts[:, 5:]], axis=1)


def _slice_features(raw: np.ndarray, off: np.ndarray, insults: np.ndarray, contempt: np.ndarray,
                    function: np.ndarray, before: np.ndarray | None = None) -> Features:
    """Features of the texts of one slice; ``before`` is the last word of the piece before, of the same text."""
    docs = len(off) - 1
    w = textvec.Words(raw, off)
    words, n = w.hashes(), np.diff(w.at)
    owner = np.repeat(np.arange(docs), n)
    add = lambda x: np.bincount(owner, weights=x, minlength=docs)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    if before is not None and len(before):
        same[:1] = words[:1] == before
    letters = _sums(_LETTER[raw], w.starts, w.ends)
    upper = _sums(_UPPER[raw], w.starts, w.ends)
    symbols = _sums(_SYMBOL[raw], w.starts, w.ends)
    size = w.ends - w.starts
    last = raw[w.ends - 1] if len(words) else raw[:0]
    tail = _SYMBOL[last] & (size > 1)
    shape = (np.minimum(symbols, 3) * 2 + same) * 2 + ((upper > 1) & (upper * 2 > letters))
    shape = ((shape * 2 + tail) * 2 + (letters == 0)) * 8 + np.minimum(size // 4, 7)
    key, count = np.unique(owner * SHAPES + shape, return_counts=True)

    t = textvec.Words(raw, off, textvec.MARK)
    token, towner = t.hashes(), np.repeat(np.arange(docs), np.diff(t.at))
    hit = lambda table: np.bincount(towner[_in(token, table)], minlength=docs)
    tsize = t.ends - t.starts
    parts, owners = [token], [towner]
    for m in BEGINNINGS:
        long = tsize > m
        parts.append(textvec.mix(t.hashes(m)[long] + np.uint64(m)))
        owners.append(towner[long])
    feature = np.concatenate(parts) >> np.uint64(64 - FEATURE_BITS)
    counts = np.stack([add(same), add(symbols), add(upper), add(tail), hit(function), hit(insults), hit(contempt)], axis=1)
    whole = np.stack([n, add(size), add(letters), n, np.diff(t.at)], axis=1)
    return Features(n, counts, whole, np.stack([key // SHAPES, key % SHAPES, count], axis=1),
                    np.concatenate(owners), feature, words[-1:])


_TABLES: list[np.ndarray] = []


def _joined(parts: list[Features]) -> Features:
    """Features of one text from those of its pieces: all counts are added."""
    shape, at = np.unique(np.concatenate([f.shapes[:, 1] for f in parts]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([f.shapes[:, 2] for f in parts]), minlength=len(shape))
    return Features(*[np.sum([getattr(f, x) for f in parts], axis=0) for x in ("n", "counts", "whole")],
                    np.stack([np.zeros_like(shape), shape, count.astype(shape.dtype)], axis=1),
                    *[np.concatenate([getattr(f, x) for f in parts]) for x in ("owner", "feature")], parts[-1].last)


def text_features(texts: pa.Array) -> Iterator[Features]:
    """Features of consecutive texts, about a megabyte of text at a time."""
    if not _TABLES:
        _TABLES.extend(_hash_of(x) for x in (INSULTS, CONTEMPT, FUNCTION_WORDS))
    raw, off = textvec.flat(texts)
    for i, j in textvec.doc_slices(off):
        parts: list[Features] = []
        for r, o in textvec.pieces(raw, off[i:j + 1], textvec.SPACE):
            f = _slice_features(r, o, *_TABLES, parts[-1].last if parts else None)
            if parts and not len(f.last):
                f.last = parts[-1].last                    # a piece without a word
            parts.append(f)
        yield parts[0] if len(parts) == 1 else _joined(parts)


def votes(f: Features) -> np.ndarray:
    """Votes per text (2 bad, 1 good, 0 none) of the five junk and two abuse labellers."""
    def rule(x, good, bad):
        return np.where(x >= bad, 2, np.where(x <= good, 1, 0))
    m = f.measures
    out = np.stack([rule(m[:, 0], 0.05, 0.25), rule(m[:, 1], 0.02, 0.12), rule(m[:, 2], 0.15, 0.6),
                    rule(m[:, 3], 0.10, 0.4), np.where(f.n < 20, 0, np.where(m[:, 4] >= 0.08, 1, 0)),
                    np.where(m[:, 5] > 0, 2, 0), np.where(m[:, 6] > 0, 2, 0)], axis=1)
    out[f.n < 4, :5] = 1                               # too short to tell: nothing speaks against it
    return out


def _votes_udf(batches):
    for batch in batches:
        v = np.concatenate([np.zeros((0, 7), dtype=np.int64), *map(votes, text_features(batch.column("text")))])
        junk, abuse = (v[:, a:b] @ (3 ** np.arange(b - a)) for a, b in ((0, 5), (5, 7)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(junk, type=pa.int32()),
                                          pa.array(abuse, type=pa.int32())], names=["doc_id", "junk", "abuse"])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 80) -> tuple[float, np.ndarray]:
    """Prior of bad and ``P(vote | class)`` as [labeller, class, vote], by EM over vote patterns.

    Two bounds keep the classes what they are named: a labeller calls at most
    ``FALSE_ALARM`` of the good documents bad; and since a bad document is often
    bad in one way only, a heuristic's vote for good (all labellers but the last,
    the labels) is at most twice as likely for good documents.
    """
    k = patterns.shape[1]
    table = np.empty((k, 2, 3))
    table[:, 0] = [0.2, 0.799, 0.001]
    table[:, 1] = [0.3, 0.5, 0.2]
    prior = 0.1
    for _ in range(rounds):
        post = posterior(patterns, prior, table)
        weight = np.stack([counts * (1 - post), counts * post], axis=1)
        prior = float(np.clip((weight[:, 1].sum() + 1) / (counts.sum() + 10), 1e-4, 0.9))
        for j in range(k):
            for v in range(3):
                table[j, :, v] = weight[patterns[:, j] == v].sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        table[:, 0, 2] = np.minimum(table[:, 0, 2], FALSE_ALARM)
        table[:-1, 1, 0] = np.maximum(table[:-1, 1, 0], 0.5 * table[:-1, 0, 0])
        table[:-1, 1, 1] = np.maximum(table[:-1, 1, 1], 0.5 * table[:-1, 0, 1])
        table /= table.sum(axis=2, keepdims=True)
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Chance of bad for each vote pattern."""
    log = np.log(np.array([1 - prior, prior]))[None, :].repeat(len(patterns), axis=0)
    for j in range(patterns.shape[1]):
        log += np.log(table[j][:, patterns[:, j]].T)
    return 1.0 / (1.0 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_linear(x: np.ndarray, y: np.ndarray, l1: float, rounds: int = 300, positive: bool = False):
    """Logistic weights and bias by accelerated proximal gradient steps with an L1 penalty."""
    n, m = x.shape
    w, b, z, zb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    v = np.ones(m)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1.0 / (0.25 * (float(np.linalg.norm(x @ v)) ** 2 / n + 1.0) * 1.1 + 1e-9)
    for _ in range(rounds):
        g = 1.0 / (1.0 + np.exp(-np.clip(x @ z + zb, -50, 50))) - y
        new = z - step * (x.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0.0)
        if positive:
            new = np.maximum(new, 0.0)
        new_b, nt = zb - step * float(g.mean()), (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return w, float(b)


@dataclass
class Scorer:
    junk: np.ndarray              # weight per shape
    junk_bias: float
    features: np.ndarray          # sorted hashed features with a weight
    weights: np.ndarray
    abuse_bias: float

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chances of junk and of abuse for each text."""
        found = [self.chances(f) for f in text_features(texts)]
        return tuple(np.concatenate([np.zeros(0), *[x[k] for x in found]]) for k in range(2))

    def chances(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        docs = len(f.n)
        doc, shape, count = f.shapes.T
        share = count / np.maximum(f.n[doc], 1)
        junk = np.bincount(doc, weights=self.junk[shape] * share, minlength=docs) + self.junk_bias
        known = _in(f.feature, self.features)
        pair = np.unique(np.stack([f.owner[known].astype(np.uint64), f.feature[known]], axis=1), axis=0)
        at = np.searchsorted(self.features, pair[:, 1])
        abuse = np.bincount(pair[:, 0].astype(np.int64), weights=self.weights[at] if len(at) else None,
                            minlength=docs) + self.abuse_bias
        logistic = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
        return np.where(f.n > 0, logistic(junk), 1.0), np.where(f.n > 0, logistic(abuse), 0.0)


def _digits(code: np.ndarray, k: int) -> np.ndarray:
    return np.stack([code // 3 ** j % 3 for j in range(k)], axis=1).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Scorer:
    """Fit both scorers; vote counts cover all documents, the scorers' sample is bounded by ``sample`` rows.

    ``labels(doc_id, quality, toxic)``: 0/1 values, null where unknown; of repeated labels the worse counts.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if labels is None:
        labels = rows.select("doc_id").limit(0).selectExpr("doc_id", "0 quality", "0 toxic")
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.expr("case when quality is null then 0 when quality = 0 then 2 else 1 end").alias("lj"),
        F.expr("case when toxic is null then 0 when toxic = 1 then 2 else 1 end").alias("la")).groupBy("doc_id").agg(
        F.max("lj").alias("lj"), F.max("la").alias("la")).filter("doc_id is not null")
    cast = rows.mapInArrow(_votes_udf, "doc_id long, junk int, abuse int").join(known, "doc_id", "left").fillna(
        0, ["lj", "la"]).withColumn("labelled", ((F.col("lj") > 0) | (F.col("la") > 0)).cast("int"))
    table = cast.groupBy("junk", "abuse", "lj", "la").agg(
        F.count("*").alias("c"), F.sum("labelled").alias("labelled")).collect()     # at most 3^9 rows
    if not table:
        return Scorer(np.zeros(SHAPES), -20.0, np.zeros(0, np.uint64), np.zeros(0), -20.0)
    code = np.array([[r["junk"], r["abuse"], r["lj"], r["la"]] for r in table], dtype=np.int64)
    count = np.array([r["c"] for r in table], dtype=np.float64)
    pj = np.concatenate([_digits(code[:, 0], 5), code[:, 2:3]], axis=1)
    pa_ = np.concatenate([_digits(code[:, 1], 2), code[:, 3:4]], axis=1)
    post = [posterior(p, *fit_labellers(p, count)) for p in (pj, pa_)]
    chance = {tuple(c): (float(a), float(b)) for c, a, b in zip(code.tolist(), *post)}

    labelled, total = int(sum(r["labelled"] for r in table)), int(count.sum())
    scale = 1 << 30
    base, size = (rows.join(known, "doc_id"), labelled) if labelled else (
        rows.withColumn("lj", F.lit(0)).withColumn("la", F.lit(0)), total)
    rate = min(scale, -(-scale * sample // max(size, 1)))
    chosen = base.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(scale)) < rate).limit(2 * sample)
    found = chosen.mapInArrow(_sample_udf, "votes array<int>, n long, shapes array<long>, counts array<long>, "
                              "features array<long>").toArrow()            # bounded by the sample
    return _fit(found, chance)


def _sample_udf(batches):
    for batch in batches:
        lj, la = batch.column("lj").to_pylist(), batch.column("la").to_pylist()
        out = []
        for f in text_features(batch.column("text")):
            v = votes(f)
            order = np.argsort(f.owner, kind="stable")
            cut = np.searchsorted(f.owner[order], np.arange(len(f.n) + 1))
            for i in range(len(f.n)):
                own = f.shapes[f.shapes[:, 0] == i]
                at = len(out)
                code = [int(v[i, :5] @ (3 ** np.arange(5))), int(v[i, 5:] @ (3 ** np.arange(2))), lj[at], la[at]]
                out.append({"votes": code, "n": int(f.n[i]), "shapes": own[:, 1].tolist(),
                            "counts": own[:, 2].tolist(),
                            "features": np.unique(f.feature[order[cut[i]:cut[i + 1]]]).astype(np.int64)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("votes", pa.list_(pa.int32())), ("n", pa.int64()), ("shapes", pa.list_(pa.int64())),
            ("counts", pa.list_(pa.int64())), ("features", pa.list_(pa.int64()))]))


def _fit(found: pa.Table, chance: dict) -> Scorer:
    found = found.combine_chunks()
    rows = found.num_rows
    prob = np.array([chance.get(tuple(v), (0.0, 0.0)) for v in found.column("votes").to_pylist()]).reshape(rows, 2)
    n = np.maximum(found.column("n").to_numpy(), 1)
    lists = {}
    for c in ("shapes", "counts", "features"):
        col = found.column(c)
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
        size = col.value_lengths().to_numpy(zero_copy_only=False) if rows else np.zeros(0, np.int64)
        lists[c] = (col.flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0, np.int64),
                    np.repeat(np.arange(rows), size))
    junk = np.zeros(SHAPES)
    junk_bias = abuse_bias = -20.0
    if rows and prob[:, 0].max() > 0.5 > prob[:, 0].min():
        shape, doc = lists["shapes"]
        used, at = np.unique(shape, return_inverse=True)
        x = np.zeros((rows, len(used)))
        x[doc, at] = lists["counts"][0] / n[doc]
        scale = np.maximum(x.max(axis=0), 1e-3)
        w, junk_bias = fit_linear(x / scale, prob[:, 0], 1e-4, 600)
        junk[used] = w / scale
    features, weights = np.zeros(0, np.uint64), np.zeros(0)
    if rows and prob[:, 1].max() > 0.5 > prob[:, 1].min():
        value, doc = lists["features"]
        used, at, df = np.unique(value, return_inverse=True, return_counts=True)
        bad = np.bincount(at, weights=prob[doc, 1])
        rank = np.where((bad >= MIN_SUPPORT) & (bad > 0.8 * df), bad, 0.0)
        pick = np.sort(np.argsort(-rank, kind="stable")[:CANDIDATES])
        pick = pick[rank[pick] > 0]
        place = np.full(len(used), -1)
        place[pick] = np.arange(len(pick))
        ok = place[at] >= 0
        x = np.zeros((rows, len(pick)))
        x[doc[ok], place[at[ok]]] = 1.0
        if len(pick):
            w, abuse_bias = fit_linear(x, prob[:, 1], 1.5e-4, 800, positive=True)
            strong = w > 0.05
            features, weights = used[pick][strong].astype(np.uint64), w[strong]
    return Scorer(junk, junk_bias, features, weights, abuse_bias)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, p_junk, p_abuse, keep`` of every whole ``text``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            junk, abuse = sent.value(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(junk), pa.array(abuse), pa.array((junk < JUNK_CUT) & (abuse < ABUSE_CUT))],
                names=["doc_id", "p_junk", "p_abuse", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, p_junk double, p_abuse double, keep boolean")


def keep_good(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``docs`` that are neither junk nor abusive."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            junk, abuse = sent.value(batch.column("text"))
            yield batch.filter(pa.array((junk < JUNK_CUT) & (abuse < ABUSE_CUT)))

    return docs.mapInArrow(released(run), docs.schema)
