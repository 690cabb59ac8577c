"""Near-duplicates, decontamination, URLs, chats: brute force on small tables and odd rows."""

import collections
import hashlib
import itertools
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from corpus_cases import SF001, SF01, none, odd, table  # noqa: F401
from tabscope.llm import chat, decontam, minhash, queries, urls
from tabscope.llm.common import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, num):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for a, b in {p for m in by.values() for p in itertools.combinations(sorted(m), 2)}:
        n = len(sets[a] & sets[b])
        if 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(rng.randint(1, 90))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        out.append((i, (" " if i % 3 else "\n").join(w).upper() if i % 2 else " ".join(w)))
    return out


@pytest.mark.parametrize("small,k,num", [(False, 3, 85), (True, 5, 80)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small, k, num):
    if small:            # many blocks, pivots and whole buckets
        for name, value in (("BLOCK_ROWS", 5), ("PIVOTS", 2), ("BUCKET_LIMIT", 6)):
            monkeypatch.setattr(minhash, name, value)
    docs = near_copies(k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(df, k, num, 100).collect()}
    assert got == components(docs, k, num)


def test_op8_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents", SF001).collect()]
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op8_minhash_dedup(spark, SF001).collect()}
    assert got == components(docs, 3, 85)


def test_bands_find_pairs_at_the_threshold():
    for t in (0.8, 0.85):
        r = minhash.band_rows(t)
        assert (1 - t ** r) ** (minhash.REGISTERS // r) <= 2e-5


def test_near_duplicates_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 1 and not by[5]["kept"]
    assert by[2]["n_shingles"] == by[4]["n_shingles"] == 0 and by[3]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = minhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert minhash.near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    chain, star = {names[i] for i in range(41)}, {names[100 + i] for i in range(60)}
    assert got == {x: min(g) for g in (chain, star) for x in g}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def best_windows(docs, items, k=5):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = words(text)
        for item, passage in items:
            p = words(passage)
            if not p:
                continue
            s = min(k, len(p))
            bag = lambda x: collections.Counter(tuple(x[i:i + s]) for i in range(len(x) - s + 1))
            own, size, best = bag(p), min(len(p), len(w)), None
            if size < s or not own.keys() & bag(w).keys():
                continue                               # a window without a common shingle is unlike
            for start in range(len(w) - size + 1):
                here = bag(w[start:start + size])
                both = sum((here & own).values())
                like = both / (sum(here.values()) + sum(own.values()) - both)
                if best is None or like > best[1]:
                    best = (start, like)
            if best and best[1] >= 0.8:
                out[d, item] = best
    return out


def test_leaks_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 9, 30, 30, 45, 60])]
    items += [(8, None), (9, " !! "), (10, "one two one two one two one two one two one two")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _, p in rng.sample(items[:8] + items[10:], 2):
            part = p.split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                part[rng.randrange(len(part))] = word()
            if rng.random() < 0.3:
                part = part[:-1] or part
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," if rng.random() < 0.2 else x for x in part]
        docs.append((i, "  ".join(w)))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in got}
    exp = best_windows(docs, items)
    assert len(exp) > 40
    assert {p: round(v[1], 9) for p, v in found.items()} == {p: round(v[1], 9) for p, v in exp.items()}
    assert {p: v[0] for p, v in found.items()} == {p: v[0] for p, v in exp.items()}


def test_op10_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents", SF001).collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", SF001).collect()]
    got = {(r["doc_id"], r["item_id"]): r["start"] for r in queries.op10_decontamination(spark, SF001).collect()}
    assert got == {p: v[0] for p, v in best_windows(docs, items).items()}


def test_block_index_reaches_the_whole_radius(spark):
    rng = random.Random(6)
    for _ in range(300):
        flips = rng.sample(range(64), rng.randint(0, decontam.RADIUS))
        blocks = collections.Counter(f // decontam.BLOCK_BITS for f in flips)
        assert min(blocks[b] for b in range(decontam.BLOCKS)) <= decontam.NEAR


def test_simhash_by_brute_force(spark):
    rng = random.Random(7)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 60))],) for _ in range(30)]
    df = spark.createDataFrame(rows, "g array<long>")
    for lane in (16, 32):
        for r in df.select("g", decontam.simhash("g", lane).alias("f")).collect():
            # bit i of a lane group is bit i + lane * j of the hash
            bits = [2 * sum((x >> b) & 1 for x in r["g"]) > len(r["g"]) for b in range(64)]
            assert r["f"] & ((1 << 64) - 1) == sum(1 << b for b in range(64) if bits[b])


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "on the mat and the dog lay on the rug"), (2, None), (3, "")],
                                  "item_id long, text string")
    got = decontam.find_leaks(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (5, 1)}
    kept = decontam.drop_leaking(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontam.drop_leaking(odd, bench.limit(0)).count() == odd.count()


def test_urls_follow_the_longest_rule(spark):
    pages = [(1, "https://Sub.EXAMPLE.com/en/x?q=1#f"), (2, "http://www.example.com/en/y"), (3, "http://a.net/es/1"),
             (4, "http://a.net"), (5, None), (6, "no scheme"), (7, "x://b.com"), (8, "x://b.com?://c.net/es/"),
             (9, "http://notexample.com/en/"), (9, "http://notexample.com/en/"), (10, "http://b.com/"), (11, "")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted(tuple(r) for r in urls.judge(df, queries.PAGE_RULES).collect())
    rule = {r[0]: r[3] for r in got}
    assert len(got) == len(pages)
    assert rule == {1: "example.com/en/", 2: "www.example.com/en/", 3: "net/es/", 4: None, 5: None, 6: None, 7: None,
                    8: None, 9: "com/", 10: "com/", 11: None}
    assert {r[0]: (r[1], r[2]) for r in got}[1] == ("sub.example.com", "/en/x")
    assert all(r[4] in ("allow", "block") for r in got)
    assert urls.judge(df.limit(0), queries.PAGE_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_url_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://h{i % 7}.site.{'net' if i % 2 else 'com'}/{'es' if i % 2 else 'p'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://k{i}.other.{'net' if i % 2 else 'com'}/zz/{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block", "net/es/"), ("allow", "com/p/")]
    got = {r["page_id"]: r for r in urls.judge(df, rules).collect()}
    rest = [got[1000 + i] for i in range(40)]
    assert all(r["rule"] is None for r in rest)
    assert sum(r["verdict"] == ("block" if i % 2 else "allow") for i, r in enumerate(rest)) > 30


def test_op7_digests(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, "conversations", SF01).collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    talks = collections.defaultdict(list)
    for r in sorted(rows):
        talks[r[0]].append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, SF01).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_escapes_and_odd_rows(spark):
    nasty = ["", "\\", "\\b\\h\\l\\c", "### a: b</turn>\n", "</turn>\n### assistant: x", "#<\\>", ": ", "é🙂\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, None, "x"), (2, 1, "a: #<", None), (3, 0, "assistant", "one"), (None, 0, "user", "u"),
             (None, 1, "assistant", "v"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, None, "system", "s"),
             (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "# " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.layouts_of(df))).collect()}
    exp = collections.defaultdict(list)
    for c, _, role, text in rows:
        exp[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in back.items()} == dict(exp)
    assert all(r["loss_text"] == "".join(t for role, t in exp[c] if role == "assistant") for c, r in back.items())
    assert chat.format_conversations(chat.layouts_of(df.limit(0))).count() == 0


def test_layouts_are_chosen_by_their_fields(spark):
    tables = {
        "prompt string, completion string, extra int": [("p", "c", 1)],
        "system string, prompt string, response string": [(None, "p", "c")],
        "instruction string, input string, output string": [("p", None, "c")],
        "messages array<struct<role:string,content:string,id:int>>": [([("user", "p", 1), ("assistant", "c", 2)],)],
        "conversations array<struct<from:string,value:string>>": [([("human", "p"), ("gpt", "c")],)],
    }
    for schema, rows in tables.items():
        df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, " + schema)
        assert [tuple(t) for t in chat.canonical(df).first()["turns"]] == [("user", "p"), ("assistant", "c")], schema
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id long, body string"))
