"""The prefix trie by brute force on small tables, over few and many blocks; odd rows."""

import collections
import hashlib
import random
import zlib

import pytest

from corpus_cases import none, odd  # noqa: F401
from tabscope.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs):
    """Expected rows of ``{conv_id: [(role, text), ...]}``."""
    members = collections.defaultdict(list)
    for c, w in convs.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p],
                    sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    """Turns of each conversation in order; equal turn numbers by role and md5 of the turn."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, name, text))
    return {c: [(x[2], x[4]) for x in sorted(w)] for c, w in own.items()}


def rebuilt(own):
    out = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + w[h:]
    return out


def chats(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < .9:
            for t in range(rng.choice([1, 2, 2, 3, 5, 12])):
                rows.append((c, t, rng.choice("ua"), rng.choice(["hé", "yes", "", "no more", None])))
    rows += [(n + i, t, "u", "same") for i in range(40) for t in range(3)]       # copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_trie_by_brute_force(spark, parts):
    own = ordered(chats(parts, 90))
    df = spark.createDataFrame(chats(parts, 90), "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(prefix_trie.flat(prefix_trie.sequences(df)), parts=parts)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == trie(own)


def test_rebuilt_trie(spark, tmp_path):
    rows = chats(5, 120)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rebuilt(ordered(rows)))


def test_trie_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (None, 0, "u", "lost"), (2, None, "", ""),
            (2, 0, "u", "a"), (-3, 5, "u", "ab" * 300_000), (4, 1, "a:b", "c"), (5, 1, "a", "b:c")]
    wide = "conv_id long, turn long, role string, text string, seq int, block int, name int, ghost int, turns int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], wide)
    got = prefix_trie.prefix_trie(prefix_trie.flat(prefix_trie.sequences(df)))
    assert sorted(map(tuple, got.collect()), key=repr) == trie(ordered(rows))
    assert prefix_trie.prefix_trie(prefix_trie.flat(prefix_trie.sequences(df.limit(0)))).count() == 0
    turnless = spark.createDataFrame([(3, []), (1, [])], "conv_id long, turns array<struct<name:binary,size:int>>")
    got = prefix_trie.prefix_trie(prefix_trie.flat(turnless)).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]


def test_long_member_lists_over_blocks(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id AS conv_id", "0 AS turn", "'u' AS role", "'hi' AS text")
    got = prefix_trie.prefix_trie(prefix_trie.flat(prefix_trie.sequences(df)), parts=9).orderBy("depth").collect()
    every = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    nobody = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got] == [(0, 0, None, 3000, 1, 1, 5998, nobody), (0, 1, 0, 3000, 0, 1, 5998, every)]
