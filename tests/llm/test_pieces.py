"""Pieces cut by numpy and encoded in blocks (op1_token_files)."""

import json
import random
import sys

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from tabscope.llm import chunks, pieces, textvec, token_files

BPE = P.path("byte_bpe_50k.json")
PARTS = [*"abZ  \n\t\r'sdtrelvm019,.!?éñ漢🙂𝒜\x1c\x85\xa0 　​́٣Ⅷ_-", "'s", "'ve", "'ll", "'re", " '", "  ", "\n "]


def _texts(n, seed, parts=PARTS, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def _many(encoder, texts):
    ids, off = encoder.many(pa.array(texts, type=pa.string()))
    return [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:])]


def test_new_words_reach_the_library_in_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "_LOADED", {})
    encoder = token_files.library_encoder(BPE)
    rng, calls = random.Random(8), []
    words = list({"".join(rng.choice("etaoinshr") for _ in range(12)) for _ in range(2000)})
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "c_call" and arg.__name__ == "tokenize" else None)
    try:
        encoder.many(pa.array([" ".join(words)]))
    finally:
        sys.setprofile(None)
    assert 0 < len(calls) < len(words) / 10


def test_pieces_are_those_of_the_pattern():
    find = regex.compile(chunks.PATTERN).findall
    texts = _texts(6000, 1)
    data, off = textvec.flat(pa.array(texts))
    raw = np.append(data[:off[-1]], np.zeros(2, dtype=np.uint8))
    begin = pieces.piece_begins(raw, off).tolist()
    found = [raw[a:z].tobytes().decode() for a, z in zip(begin, [*begin[1:], int(off[-1])])]
    assert found == [p for t in texts for p in find(t)]


@pytest.mark.parametrize("alone", [False, True])
def test_ids_are_those_of_the_library(tmp_path, monkeypatch, alone):
    path = BPE
    if alone:                                                  # a vocabulary in which merges may take in any byte
        spec = json.load(open(BPE, encoding="utf-8"))
        spec["model"]["ignore_merges"] = True
        path = str(tmp_path / "t.json")
        json.dump(spec, open(path, "w", encoding="utf-8"))
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "_LOADED", {})
    encoder = token_files.library_encoder(path)
    encoder.pieces.entries = 300                               # entries come and go
    for seed in range(5):
        texts = [*_texts(300, seed), *_texts(300, seed, [*PARTS, "<|endoftext|>"]), *_texts(20, seed, longest=1500), None, ""]
        assert _many(encoder, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(encoder.pieces.keys) <= 300


def test_added_tokens_with_rules_of_their_own(tmp_path, monkeypatch):
    spec = json.load(open(BPE, encoding="utf-8"))
    spec["added_tokens"].append({"id": 50300, "content": "<mask>", "single_word": False, "lstrip": False, "rstrip": True,
                                 "normalized": False, "special": True})
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    library, texts = Tokenizer.from_file(path), _texts(300, 2, [*PARTS, "<mask>"])
    monkeypatch.setattr(token_files, "_LOADED", {})
    assert _many(token_files.library_encoder(path), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
