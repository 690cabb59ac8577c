"""Token files, byte-pair encoding and word-piece counts against the public libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from corpus_cases import SF001, none, odd, table  # noqa: F401
from tabscope.llm import bpe, queries, token_counts, token_files

BPE = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(BPE)


def _strings(n, seed=3):
    rng = random.Random(seed)
    parts = [*"abc ABC  \n\t\r'sdtrelvm019,.!?éñ漢🙂\x1c\x85\xa0\u2003\u200b٣Ⅷ_-", "<|endoftext|>", " the", "'re", "\\", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_both_encoders_equal_the_library(library):
    own, files = bpe.ByteBPE(BPE), token_files.library_encoder(BPE)
    for s in [*_strings(3000), "a" * 5000, "<|endoftext|>" * 3, "x y" * 4000]:
        ids = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(s), dtype="<u4").tolist() == ids, s
        assert np.frombuffer(files(s), dtype="<u4").tolist() == ids, s
        assert own.decode(own.encode(s)) == library.decode(ids, skip_special_tokens=False)


def test_many_texts_at_once_equal_the_library(library):
    texts = [None, "", *_strings(400, 4), " a b", "a  b", "a \n b", "end ", "x <|endoftext|> y", None] + ["plain words, again."] * 5
    rng = random.Random(6)
    rng.shuffle(texts)
    for encoder in (bpe.ByteBPE(BPE).encode, token_files.library_encoder(BPE)):
        for part in (pa.array(texts), pa.array(texts).slice(7, 90), pa.array(texts).slice(3, 0), pa.array(["", None])):
            ids, off = encoder.many(part)
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [
                library.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_decoding_of_any_ids_equals_the_library(library):
    own, rng = bpe.ByteBPE(BPE), random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_caches_stay_bounded_and_right(library):
    own = bpe.ByteBPE(BPE)
    for c in (own.encode.chunks, own.encode.pieces):
        c.entries = 10
    for s in _strings(200, 9):
        assert np.frombuffer(own.encode(s), dtype="<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    assert 0 < len(own.encode.chunks.keys) == len(own.encode.chunks.size) <= 10
    assert len(own.encode.pieces) <= 10 and len(own.encode.pieces.old) <= 10


def test_op9_digests(spark, library):
    rows = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF001).collect()}
    docs = table(spark, "documents", SF001).collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = np.array(library.encode(d["text"], add_special_tokens=False).ids, dtype="<u4")
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_op1_reads_back_what_the_library_encodes(spark, library):
    got = sorted(queries.op1_token_files(spark, SF001).collect(), key=lambda r: r["doc_id"])
    start = 0
    for d, r in zip(sorted(table(spark, "documents", SF001).collect(), key=lambda r: r["doc_id"]), got, strict=True):
        ids = np.array(library.encode(d["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        assert tuple(r)[:4] == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_layout(spark, tmp_path):
    out = str(tmp_path / "tokens")
    token_files.write_tokens(table(spark, "documents", SF001), BPE, out, parts=3)
    files = sorted(f for f in os.listdir(out) if f.endswith(".parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(os.path.join(out, f)).metadata
        group = meta.row_group(0)
        cols = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in cols["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
        assert cols["doc_id"].has_offset_index and cols["doc_id"].has_column_index
        ids = pq.read_table(os.path.join(out, f), columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    plan = token_files.read_tokens(spark, out).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids#" not in plan.split("== Physical Plan ==")[1]


def test_odd_rows(spark, odd, none, tmp_path):
    n = odd.count()
    coded = bpe.decode(bpe.encode(odd, BPE, keep=["doc_id", "text", "rk"]), BPE).collect()
    assert len(coded) == n and all(r["decoded"] == (r["text"] or "") for r in coded)
    assert {r["n_tokens"] for r in coded if r["doc_id"] in (2, 3)} == {0}
    arrays = bpe.encode(odd, BPE, arrays=True).collect()
    assert sorted(len(r["token_ids"]) for r in arrays) == sorted(r["n_tokens"] for r in coded)
    assert bpe.encode(none, BPE, arrays=True).count() == 0
    for i, (df, size) in enumerate(((odd, n), (none, 0))):
        out = str(tmp_path / f"t{i}")
        token_files.write_tokens(df, BPE, out)
        got = token_files.ids_checksums(token_files.read_tokens(spark, out)).orderBy("start").collect()
        assert len(got) == size
        ends = 0
        for r in got:
            assert r["start"] == ends and r["n_tokens"] >= 1
            ends += r["n_tokens"]
    counted = token_counts.token_counts(odd, PIECES).collect()
    assert len(counted) == n and {r["n_tokens"] for r in counted if r["doc_id"] in (2, 3, 4)} == {0}
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_wrong_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE(P.path("word_bpe_49k.json"))


def test_word_piece_counts_equal_the_library():
    begin, go_on = token_counts.vocabulary(PIECES)
    vocab = {"[UNK]": 0}
    for x in [*sorted(begin), *("##" + p for p in sorted(go_on))]:
        vocab.setdefault(x, len(vocab))
    model = WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10 ** 6)
    counter, rng = token_counts.WordPieceCounter(begin, go_on), random.Random(1)
    for _ in range(5000):
        w = "".join(rng.choice("abtheinrsñé漢Ωing") for _ in range(rng.randint(1, 14)))
        found = model.tokenize(w)
        assert counter.count(w) == (-1 if found[0].id == 0 else len(found)), w
    assert counter.count("a" * 20_000) > 0


def test_word_piece_failure_links_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        make = lambda: {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(5)}
        begin, go_on = make(), make()
        counter = token_counts.WordPieceCounter(begin, go_on)
        for _ in range(20):
            w, n, at, pieces = "".join(rng.choice("ab") for _ in range(rng.randint(1, 10))), 0, 0, begin
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in pieces), None)
                if end is None:
                    n = -1
                    break
                at, n, pieces = end, n + 1, go_on
            assert counter.count(w) == n, (begin, go_on, w)
