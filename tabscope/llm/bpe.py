"""Byte-pair encoding and decoding with an own merge loop.

A piece starts as one symbol per byte in a doubly linked list; adjacent pairs
that can merge wait in a priority queue by merge rank, then position. A popped
entry whose symbols have changed since is stale and skipped. Decoding
concatenates the vocabulary strings of the ids.

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE without
normaliser; its path is a parameter and every worker reads it there. Ids come as
little-endian unsigned 32-bit integers in a binary column (``ids``).

Rows: a null text counts as empty and has no ids; rows are independent, so
repeated rows and ids give repeated results; extra columns are dropped unless
named in ``keep``, where one that has a result's name comes with an underscore
before it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import released, ship

#: Chunks that a worker remembers.
CACHE_ENTRIES = 400_000
#: Bytes of text encoded at once; a slice takes some 25 bytes of memory a byte.
SLICE = 2 << 20
#: Queue entries hold a merge rank above the position of the left symbol.
_POS_BITS = 40
_POS_MASK = (1 << _POS_BITS) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        letters = byte_letters()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with stripping, normalising or word rules are not supported")
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: list[dict[int, int]] = [{} for _ in self.strings]   # of a left id: right id -> place of the rank
        self.merged: list[int] = []                                     # of a rank: new id
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left]][vocab[right]] = rank << _POS_BITS
            self.merged.append(vocab[left + right])
        self.first = [self.merges[a].get(b, -1) for a in self.byte_id for b in self.byte_id]     # of two bytes
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.encode = ChunkEncoder(self._piece, self._words, self._with_added, names, CACHE_ENTRIES)

    def piece_ids(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        sym = list(map(self.byte_id.__getitem__, data))
        n, first = len(sym), self.first
        queue = [m + i for i, (a, b) in enumerate(zip(data, data[1:])) if (m := first[a << 8 | b]) >= 0]
        if not queue:
            return sym
        merges, merged, push, pop = self.merges, self.merged, heapq.heappush, heapq.heappop
        heapq.heapify(queue)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & _POS_MASK
            left, j = sym[i], nxt[i]
            if left < 0 or j >= n or merges[left].get(sym[j]) != entry - i:
                continue                                  # stale: one of the symbols has changed
            new = sym[i] = merged[entry >> _POS_BITS]
            sym[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                m = merges[new].get(sym[k])
                if m is not None:
                    push(queue, m + i)
            p = prv[i]
            if p >= 0:
                m = merges[sym[p]].get(new)
                if m is not None:
                    push(queue, m + p)
        return [s for s in sym if s >= 0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.piece_ids(piece.encode("utf-8")))

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(self.piece_ids(b" " + w.encode("utf-8"))) for w in words]

    def _with_added(self, run: str) -> list[int]:
        return [i for x in self.special.split(run) for i in ([self.added[x]] if x in self.added else self.encode.plain(x))]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Text of little-endian uint32 ids; bytes that are no UTF-8 become U+FFFD."""
        own = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.strings.__getitem__, own)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _fields(df: DataFrame, names: Iterable[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def fresh(name: str, taken: set[str]) -> str:
    """``name`` after as many underscores as make it differ from all ``taken`` names, which it joins."""
    while name.lower() in taken:
        name = f"_{name}"
    taken.add(name.lower())
    return name


def encode(docs: DataFrame, path: str, keep: Iterable[str] = ("doc_id",), arrays: bool = False,
           decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (binary) of every whole ``text``.

    With ``arrays`` the ids come as ``token_ids array<int>`` instead; with ``decoded`` they are
    decoded again and ``decoded_sha256`` is the digest of that text."""
    keep, name = list(keep), "token_ids" if arrays else "ids"
    extra = ["decoded_sha256"] if decoded else []
    taken = {"n_tokens", name, *extra, *(c.lower() for c in keep)}
    named = {}                                            # kept column -> its name in the result
    for c in keep:
        named[c] = fresh(c, taken) if c.lower() in ("n_tokens", name, *extra) else c
    text = fresh("text", taken)
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            for i, j, ids, off in bpe.encode.slices(b.column(len(keep)), SLICE):
                if arrays:
                    own = pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), pa.array(ids.view("<i4")))
                else:
                    own = pa.Array.from_buffers(pa.large_binary(), j - i, [
                        None, pa.py_buffer(4 * off), pa.py_buffer(ids)]).cast(pa.binary())
                back = [pa.array([hashlib.sha256(bpe.decode(ids[a:z]).encode("utf-8")).hexdigest()
                                  for a, z in zip(off[:-1], off[1:])], type=pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in b.columns[:len(keep)]], pa.array(np.diff(off)), own, *back],
                    names=[*named.values(), "n_tokens", name, *extra])

    rows = docs.select(*[F.col(f"`{c}`").alias(new) for c, new in named.items()],
                       F.col("text").cast("string").alias(text))
    return rows.mapInArrow(
        released(run), ", ".join(x for x in (_fields(rows, named.values()), f"n_tokens long, {name} {'array<int>' if arrays else 'binary'}",
                                   *[f"{x} string" for x in extra]) if x))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of its ``ids`` (null ids: empty)."""
    cols = encoded.columns
    ship(encoded.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())], names=[*cols, "decoded"])

    return encoded.mapInArrow(run, _fields(encoded, cols) + ", decoded string")
