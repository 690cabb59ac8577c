"""What a Python worker keeps after a batch counts against its executor through all later stages."""

import ctypes
import random
import re

import numpy as np
import pyarrow as pa

from tabscope.llm import bpe
from tabscope.llm.common import released
from tabscope.llm.queries import vocabulary


def _trim() -> None:
    """Earlier tests' free memory goes back, so that it does not hide what is kept here."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def _own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def _texts(mb: int, seed: int) -> pa.Array:
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu019-", k=rng.randint(2, 8))) for _ in range(60_000)]
    return pa.array([" ".join(rng.choices(words, k=3000)) for _ in range(mb * 60)])


def test_freed_memory_goes_back_after_each_batch():
    held = []

    def run(batches):
        for b in batches:
            rows = [np.ones(5_000) for _ in range(4000)]                # 160 MB in small pieces
            rows = rows[::400]                                          # a few stay in between
            yield b
            held.extend(rows)

    one = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    del_me = np.ones(3_000_000)                                         # 24 MB freed: smaller blocks stay on the heap
    del del_me
    _trim()
    out = released(run)(iter([one, one, one]))
    before, sizes = _own_mb(), []
    for b in out:
        assert b.equals(one)
        sizes.append(_own_mb() - before)
    assert len(sizes) == 3 and len(held) == 30
    assert _own_mb() - before < 60


def test_encoder_keeps_little_between_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(bpe, "_LOADED", {})
    run = bpe.encode(docs, vocabulary(), arrays=True, decoded=True)

    def batches():
        for seed in range(3):
            texts = _texts(8, seed)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])

    bpe.tokenizer(vocabulary())
    _trim()
    before, rows = _own_mb(), 0
    for out in run(batches()):
        rows += out.num_rows
        del out
    kept = _own_mb() - before
    assert rows == 3 * 8 * 60
    assert kept < 70, kept


def test_slices_of_any_size_give_the_same_ids():
    own = bpe.tokenizer(vocabulary())
    texts = pa.concat_arrays([_texts(1, 7), pa.array([None, "", " a  b ", "x" * 3000])])
    whole, off = own.encode.many(texts)
    for limit in (100, 5_000, 1 << 20):
        parts = list(own.encode.slices(texts, limit))
        assert [(i, j) for i, j, _, _ in parts][0][0] == 0 and parts[-1][1] == len(texts)
        assert np.array_equal(np.concatenate([ids for _, _, ids, _ in parts]), whole)
        assert np.concatenate([np.diff(o) for *_, o in parts]).tolist() == np.diff(off).tolist()
