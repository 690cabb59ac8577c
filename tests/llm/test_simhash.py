"""SimHash fingerprints and components by brute force; the crowded prefixes; odd rows."""

import itertools
import random
import re

import pytest
import xxhash

from corpus_cases import SF001, none, odd, table  # noqa: F401
from tabscope.llm import queries, simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=3):
    """doc_id -> smallest id reachable, of (doc_id, fingerprint)."""
    up = {f: f for _, f in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(list(up), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = min(d, least.get(r, d))
    return {d: least[find(f)] for d, f in rows}


def test_op13_on_a_whole_table(spark):
    docs = [(r["doc_id"], fingerprint(r["text"])) for r in table(spark, "documents", SF001).collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op13_simhash_dedup(spark, SF001).collect()}
    comp = components(docs)
    assert got == {d: (f"{f:016x}", comp[d]) for d, f in docs}


def clusters(seed, n):
    """Fingerprints around few centres, at distances about the radius, and chains."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 7])):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("rows,crowded", [(16_384, 131_072), (64, 512), (32, 60)])
def test_ties_by_brute_force(spark, monkeypatch, rows, crowded):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)          # few rows: many prefixes, and crowded ones are cut
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    fps = clusters(rows, 700)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k: docs)
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    comp = components(list(enumerate(fps)))
    assert got == {d: (f"{f:016x}", comp[d]) for d, f in enumerate(fps)}


def test_simhash_of_texts():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = rng.choice([" ", "\n ", "\t"]).join(rng.choice(["Aé", "B c", "ZZ", "d\x1c", "ÄÖ"]) for _ in range(n))
        assert simhash.simhash(text) == fingerprint(text) == simhash.simhash(text.encode())


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    zero = "0" * 16
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == zero
    assert by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[5]["component_id"] == 1 and by[None]["component_id"] is None and by[None]["fingerprint"] != zero
    assert simhash.near_duplicates(none).count() == 0
