"""Whole-text encoding through bounded caches of space-delimited chunks and of pieces.

A byte-level BPE splitter always starts a new piece at a space that stands
between two non-space characters, so a text may be cut there and the chunks
encoded on their own. Arrow cuts the texts of a slice and numbers their distinct
chunks; each distinct chunk is looked up once, and the ids of the texts are
gathered from its ids. A worker keeps a table of chunks (Arrow strings and their
ids, a few bytes each; when full, the half used last stays) and a cache of pieces
in two generations (a full one becomes the old one, from which used entries come
back).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import textvec

#: Fixed value: how byte-level BPE vocabularies of this family split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest key that a cache keeps.
CACHE_CHARS = 48
#: Bytes of text encoded at once (a longer text is a slice of its own).
SLICE = 4 << 20
#: Marks that form a piece of their own after a word.
MARKS = frozenset(".,;:!?")

_SAFE = re.compile(r"(?<=\S) (?=\S)")


@contextmanager
def no_cycles():
    """Without the search for cycles: a slice makes some 100,000 lists of numbers, which hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class _Cache(dict):
    """``entries``: size of one generation."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make = make
        self.entries = entries
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Table:
    """Chunks and their ids; at most ``entries`` after each slice."""

    def __init__(self, entries: int):
        self.entries = entries
        self.keys = pa.array([], type=pa.large_string())
        self.size, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.now = 0

    def find(self, chunks: pa.Array) -> np.ndarray:
        """Place of each chunk, -1 for those not held."""
        self.now += 1
        at = pc.fill_null(pc.index_in(chunks, value_set=self.keys), -1).to_numpy()
        self.used[at[at >= 0]] = self.now
        return at

    def add(self, chunks: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, chunks])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(size), self.now)])
        self.ids = np.concatenate([self.ids, ids])
        if len(self.size) > self.entries:
            keep = np.sort(np.argsort(-self.used, kind="stable")[:self.entries // 2])
            n, at = self.size[keep], (np.cumsum(self.size) - self.size)[keep]
            self.ids = self.ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self.keys, self.size, self.used = self.keys.take(pa.array(keep)), n, self.used[keep]


class SliceEncoder:
    """Slices of texts, and one text, through ``many``, which gives the ids of all texts and their offsets."""

    def slices(self, texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(i, j, ids, offsets)`` of consecutive rows ``i`` to ``j`` of about ``limit`` bytes."""
        _, off = textvec.flat(texts)
        for i, j in textvec.doc_slices(off, limit):
            with no_cycles():
                found = self.many(texts.slice(i, j - i))
            yield i, j, *found

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], type=pa.large_string()))[0].tobytes()


class ChunkEncoder(SliceEncoder):
    """Encodes texts to uint32 ids.

    ``piece`` gives the ids of one piece, ``words`` those of words of letters after a
    space; ``special`` names the added tokens, which ``whole`` encodes with the text
    around them.
    """

    def __init__(self, piece: Callable[[str], Sequence[int]], words: Callable[[list[str]], list[tuple[int, ...]]],
                 whole: Callable[[str], list[int]], special: Iterable[str], entries: int):
        self.find = regex.compile(PATTERN).findall
        self.words = words
        self.whole = whole
        self.special = list(special)
        self.pieces = _Cache(piece, entries // 4)                # of chunks that are more than a word and a mark
        self.chunks = _Table(entries)                            # keys lost the space before them

    def plain(self, run: str) -> list[int]:
        """Ids of a run without added tokens."""
        return [i for p in map(self.pieces.__getitem__, self.find(run)) for i in p]

    def any(self, run: str) -> list[int]:
        return self.whole(run) if any(s in run for s in self.special) else self.plain(run)

    def _encoded(self, chunks: list[str]) -> tuple[list, list[int]]:
        """Ids of each chunk with the space before it, and which chunks have white space at an end."""
        stems: dict[str, int] = {}                          # words, alone or before a mark, are encoded once
        out: list = [None] * len(chunks)
        simple, unsafe = [], []
        for i, c in enumerate(chunks):
            if c.isalpha():
                simple.append((i, stems.setdefault(c, len(stems)), ""))
            elif c and c[-1] in MARKS and c[:-1].isalpha():
                simple.append((i, stems.setdefault(c[:-1], len(stems)), c[-1]))
            elif not c or c[0].isspace() or c[-1].isspace():
                unsafe.append(i)
                out[i] = []
            else:
                out[i] = self.any(" " + c)
        words = self.words(list(stems))
        for i, w, mark in simple:
            out[i] = (*words[w], *self.pieces[mark]) if mark else words[w]
        return out, unsafe

    def _uncut(self, text: str) -> list[int]:
        """Ids of a text in which white space stands beside a space."""
        parts = _SAFE.split(text)
        return self.any(parts[0]) + [i for c in parts[1:] for i in self.any(" " + c)]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n+1 offsets of the texts (null counts as empty)."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        begin, head = begin - begin[0], begin[:-1] - begin[0]
        coded = cut.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        body = np.ones(len(code), dtype=bool)
        body[head] = False
        wanted = np.zeros(len(words), dtype=bool)
        wanted[code[body]] = True
        place = self.chunks.find(words)
        missed = np.flatnonzero(wanted & (place < 0))
        new, unsafe_new = self._encoded(words.take(pa.array(missed)).to_numpy(zero_copy_only=False).tolist())
        unsafe = np.zeros(len(words), dtype=bool)
        unsafe[missed[unsafe_new]] = True
        first = words.take(pa.array(code[head])).to_numpy(zero_copy_only=False).tolist()
        lone = np.diff(begin) == 1
        bad = (np.add.reduceat(unsafe[code] & body, head) > 0) if len(head) else np.zeros(0, dtype=bool)
        bad |= np.array([not one and (not h or h[-1].isspace()) for h, one in zip(first, lone.tolist())], dtype=bool)
        for i, (h, wrong) in enumerate(zip(first, bad.tolist())):
            new.append(self._uncut(texts[i].as_py()) if wrong else self.any(h))

        # entries: the table's chunks, the new chunks, then one per text, which stands at its head
        size = np.concatenate([self.chunks.size, np.fromiter(map(len, new), dtype=np.int64, count=len(new))])
        ids = np.concatenate([self.chunks.ids, np.fromiter(chain.from_iterable(new), dtype="<u4")])
        at = np.cumsum(size) - size
        held = len(self.chunks.size)
        place = place.astype(np.int64)
        place[missed] = held + np.arange(len(missed))
        entry = place[code]
        entry[head] = held + len(missed) + np.arange(len(head))
        n = size[entry]
        n[body & np.repeat(bad, np.diff(begin))] = 0             # a text encoded as a whole has no other entry
        total = np.cumsum(n)
        if len(total):
            out = ids[np.repeat(at[entry] - (total - n), n) + np.arange(total[-1])]
        else:
            out = ids[:0]
        short = pc.less_equal(pc.utf8_length(words.take(pa.array(missed))), CACHE_CHARS).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(short & ~unsafe[missed])
        if len(kept):
            n = size[held + kept]
            own = ids[np.repeat(at[held + kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self.chunks.add(words.take(pa.array(missed[kept])), n, own)
        return out, np.concatenate([[0], total[begin[1:] - 1]]).astype(np.int64) if len(head) else np.zeros(1, np.int64)
