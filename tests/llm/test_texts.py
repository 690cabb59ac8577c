"""Quality, language, fingerprints: held-out accuracy, brute force and odd rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from corpus_cases import SF1, SF01, none, odd, table  # noqa: F401
from tabscope.llm import fingerprints, language, quality, queries, textvec


def test_quality_finds_labelled_junk_and_keeps_good_documents(spark):
    docs, labels = table(spark, "documents", SF1), table(spark, "labels", SF1)
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert len(got) == labels.count()
    assert got.keep[good].mean() > 0.995
    assert got.keep[got.quality == 0].mean() < 0.05
    assert got.keep[got.toxic == 1].mean() < 0.1


def test_labellers_are_weighed_by_their_accuracy():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.2
    rates = [(0.0008, 0.7), (0.0005, 0.3), (0.0009, 0.5), (0.0002, 0.9)]
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, b, a), 2, 0) for a, b in rates], axis=1)
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, acc = quality.fit_labellers(patterns, count.astype(float))
    assert abs(prior - 0.2) < 0.03
    assert acc[3, 1, 2] > acc[0, 1, 2] > acc[2, 1, 2] > acc[1, 1, 2]
    assert (quality.posterior(patterns, prior, acc)[at.ravel()] > 0.5)[truth].mean() > 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    scorer = quality.train(odd, labels)
    got = quality.score(odd, scorer).collect()
    assert len(got) == odd.count()
    assert {r["keep"] for r in got if r["doc_id"] in (2, 3, 4)} == {False}
    assert quality.keep_good(odd, scorer).columns == odd.columns
    for df in (none, odd):
        plain = quality.train(df, None)
        assert quality.score(none, plain).count() == 0
    assert quality.train(none, labels.limit(0)).junk_bias < 0


def test_language_of_held_out_documents(spark):
    docs = table(spark, "documents", SF1)
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got.held_out
    assert 0.2 < held.mean() < 0.3
    assert (got.lang == got.lang_pred)[held].mean() > 0.99
    assert got.score.between(0, 1).all()


def test_code_lengths_by_brute_force():
    texts = {"a": ["the cat sat on the mat. " * 9, "that hat is the cat's"], "b": ["le chat est la. " * 9, "où est le chat"]}
    grams, counts = [], []
    for name in sorted(texts):
        batch = pa.RecordBatch.from_pydict({"text": texts[name], "lang": [name] * 2})
        out = pa.Table.from_batches(list(language._count_grams([batch])))
        g, at = np.unique(out.column("gram").to_numpy(), return_inverse=True)
        grams.append(g)
        counts.append(np.bincount(at, weights=out.column("n").to_numpy()).astype(np.int64))
    model = language.Model(sorted(texts), grams, counts)
    fold = lambda t: [int(language.FOLD[b]) for b in t.encode()]
    table_of, total = {}, {}
    for name in texts:
        seen: dict = {}
        for t in texts[name]:
            s = [language.PAD] * 3 + fold(t)
            for i in range(3, len(s)):
                for d in range(4):
                    at = seen.setdefault(tuple(s[i - d:i]), {})
                    at[s[i]] = at.get(s[i], 0) + 1
        table_of[name] = seen
        for c, x in seen.items():
            total[c] = total.get(c, 0) + sum(x.values())

    def bits(name, ctx, byte):
        seen = table_of[name].get(ctx, {}) if not ctx or total.get(ctx, 0) >= language.MIN_COUNT else {}
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (n + q))
        rest = bits(name, ctx[1:], byte) if ctx else 8.0
        return rest + (-math.log2(q / (n + q)) if n else 0.0)
    for probe in ("the chat sat là", "x", "", "zz 99 the"):
        raw, off = textvec.flat(pa.array([probe, "the cat"]))
        got = model.lengths(raw, off)[0] / language.UNIT
        s = [language.PAD] * 3 + fold(probe)
        for k, name in enumerate(sorted(texts)):
            exp = sum(bits(name, tuple(s[i - 3:i]), s[i]) for i in range(3, len(s)))
            assert abs(got[k] - exp) < 0.01 * max(1, len(probe))


def test_long_text_code_length_is_a_sum_over_slices(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"text": [text], "lang": ["x"]})
    out = next(language._count_grams([batch]))
    model = language.Model(["x"], [out.column("gram").to_numpy()], [out.column("n").to_numpy()])
    raw, off = textvec.flat(pa.array(["ab", text, "cd"]))
    whole = model.lengths(raw, off)
    monkeypatch.setattr(textvec, "SLICE", 500)
    assert (model.lengths(raw, off) == whole).all()


def test_language_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(odd, language.train(odd)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (7, "und"), (8, "fr")} <= got
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    assert language.train(none) is None and language.identify(none, None).count() == 0
    kept = language.keep_identified(odd, language.train(odd))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 8}


def test_fingerprints_do_not_depend_on_the_batch_or_the_offset(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["", "a", "aaaaaa", "ab" * 40]
    whole = fingerprints.fingerprints(pa.array(texts))
    assert whole == [fingerprints.fingerprints(pa.array([t]))[0] for t in texts]
    assert len(set(whole)) == len(set(texts))
    long = [t for t in texts if len(t) > 1500]
    moved = fingerprints.likeness(fingerprints.fingerprints(pa.array(long)),
                                  fingerprints.fingerprints(pa.array(["some words before " + t for t in long])))
    assert moved.min() > 0.8
    other = fingerprints.likeness(whole[:50], whole[1:51])
    assert other.max() < 0.2
    assert fingerprints.likeness([whole[60], whole[60]], [whole[60], whole[61]]).tolist() == [1.0, 0.0]


def test_op5_edited_texts(spark):
    docs = sorted(table(spark, "documents", SF01).collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, SF01).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        n, follow = len(d["text"]), docs[(i + 1) % len(docs)]["text"]
        edited = d["text"][:n - n // 2] + follow[:n // 2]
        r = got[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    better = [r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 200]
    assert sum(better) / len(better) > 0.95


def test_fingerprint_odd_rows(spark, odd, none):
    rows = sorted([(r[0] if r[0] is not None else -2 ** 63, r[1] or "") for r in odd.collect()])
    for buckets in (1, 3, 50):
        got = fingerprints.edited_likeness(odd, buckets).collect()
        exp = []
        for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
            n = len(t)
            exp.append((k, n, hashlib.sha256((t[:n - n // 2] + u[:n // 2]).encode()).hexdigest()))
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -2 ** 63, r["n_chars"], r["edited_sha256"])
                      for r in got) == sorted(exp)
    assert fingerprints.edited_likeness(none).count() == 0
    assert fingerprints.fingerprint(odd).count() == odd.count()
