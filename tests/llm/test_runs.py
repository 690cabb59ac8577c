"""Periodic runs by brute force: the words compared one by one at every distance."""

import hashlib
import random
import re
import zlib

import numpy as np

from corpus_cases import SF001, none, odd, table  # noqa: F401
from tabscope.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    runs = runs_of(w)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest(said), digest(collapsed(w, runs)))


def periodic(seed, n):
    rng = random.Random(seed)
    w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 4 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 6))
        for i in range(a, a + rng.randint(1, n - a)):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_by_brute_force():
    for seed in range(150):
        docs = [periodic((seed, i).__hash__(), n) for i, n in enumerate((0, 1, 5, 6, 7, 12, 40, 150, 400))]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic_runs.find_runs(np.array([x for d in docs for x in d], dtype=np.int64), off)
        assert got == [runs_of(d) for d in docs]


def test_extensions_by_brute_force():
    for seed in range(30):
        w = periodic(seed, 300)
        grammar = periodic_runs.Grammar(np.array([-1, *w, -2], dtype=np.int64))
        rng = random.Random(seed)
        pairs = [sorted(rng.sample(range(1, 301), 2)) for _ in range(200)]
        i, j = (np.array(x) for x in zip(*pairs))
        line = [-1, *w, -2]

        def ahead(a, b):
            k = 0
            while line[a + k] == line[b + k]:
                k += 1
            return k

        def behind(a, b):
            k = 0
            while line[a - k - 1] == line[b - k - 1]:
                k += 1
            return k
        assert grammar.forwards(i, j).tolist() == [ahead(a, b) for a, b in pairs]
        assert grammar.backwards(i, j).tolist() == [behind(a, b) for a, b in pairs]


def test_op11_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents", SF001).collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF001).collect()}
    assert got == {d: expected(d, t) for d, t in docs}


def test_op11_planted_words(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, rng.choice([" ", "\n\t", "  ", "\r\n"]).join("É%d" % x for x in periodic(i, rng.choice([1, 3, 8, 60, 200]))))
            for i in range(400)] + [(400, None), (401, ""), (402, " \n"), (None, "a a a a a a a"), (403, "x " * 50_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    small = [d for d in docs if d[0] != 403]
    assert {d: got[d] for d, _ in small} == {d: expected(d, t) for d, t in small}
    assert got[403][1:5] == (1, 0, 50_000, 1)


def test_runs_odd_rows(spark, odd, none):
    got = periodic_runs.periodic_runs(odd, keep=["doc_id", "n"]).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[4]["collapsed"] == "" == by[2]["collapsed"]
    assert by[8]["n_words"] == 300_000 and [tuple(r) for r in by[8]["runs"]] == [(0, 300_000, 5)]
    assert by[8]["collapsed"] == "le chat et le chien" and by[None]["n_words"] == 9
    assert periodic_runs.periodic_runs(none).count() == 0
