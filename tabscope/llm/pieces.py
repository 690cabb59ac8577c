"""Whole-text encoding where numpy cuts the pieces and a library encodes the new ones of a slice together.

The splitter's pattern is evaluated on the bytes of all texts of a slice: a piece
begins where the class of characters changes, with the rules for white space and
contractions on top. Arrow numbers the distinct pieces; those that the worker's
table does not hold go to ``batch`` at once, and the ids of the texts are
gathered from the ids of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import textvec
from .chunks import _SAFE, CACHE_CHARS, SliceEncoder, _Table

#: Classes of characters that ``chunks.PATTERN`` tells apart (0: not met yet).
_LETTER, _NUMBER, _BLANK, _REST = 1, 2, 3, 4
_CLASS = np.zeros(0x110000, dtype=np.uint8)


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point."""
    found = _CLASS[points]
    if not found.all():
        for p in np.unique(points[found == 0]).tolist():
            c = chr(p)
            _CLASS[p] = (_LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c)
                         else _BLANK if regex.match(r"\s", c) else _REST)
        found = _CLASS[points]
    return found


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 ``raw`` belongs to."""
    kind = classes(np.arange(128))[raw & 0x7F]
    lead = np.flatnonzero(raw >= 0xC0)
    for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = lead[(raw[lead] >= low) & (raw[lead] < high)]
        point = (raw[at] & bits).astype(np.int32)
        for i in range(1, size):
            point = point << 6 | raw[at + i] & 0x3F
        found = classes(point)
        for i in range(size):
            kind[at + i] = found
    return kind


def piece_begins(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: ``raw`` are their bytes, then two others, ``off`` the n+1 offsets."""
    n = int(off[-1])
    kind = byte_classes(raw[:n])
    fresh = np.zeros(n + 2, dtype=bool)                        # where a text begins, and after the last one
    fresh[off] = True
    fresh[n:] = True
    starts = fresh[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # the last character of white space before another stands alone; a space goes with what follows
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK))
    last = last[~fresh[last + 1]]
    first = last.copy()
    for _ in range(3):
        first -= (raw[first] & 0xC0) == 0x80
    starts[first] = True
    starts[last + 1] = raw[last] != 0x20
    # contractions: 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero(raw[:n] == 0x27)
    mark = mark[starts[mark] & ~fresh[mark + 1]]
    one, two = raw[mark + 1], raw[mark + 2]
    single = np.isin(one, list(b"stmd"))
    double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
              ) & ~fresh[mark + 2]
    mark, end = mark[single | double], (mark + 2 + double)[single | double]
    starts[mark + 1] = False
    starts[end[end < n]] = True
    return np.flatnonzero(starts)


def gather(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` values from each place ``at``, one after another."""
    total = np.cumsum(n)
    return values[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(n) else 0)]


class PieceEncoder(SliceEncoder):
    """Encodes texts to uint32 ids.

    ``batch`` gives the number of ids of each of many pieces, and all their ids; ``special``
    names the added tokens, which ``whole`` encodes with the text around them: up to a space
    between other characters, or with ``uncut`` the whole text.
    """

    def __init__(self, batch: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]],
                 whole: Callable[[str], list[int]], special: Iterable[str], entries: int, uncut: bool = False):
        self.batch = batch
        self.whole = whole
        self.special = list(special)
        self.uncut = uncut
        self.pieces = _Table(entries)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts without added tokens."""
        data, off = textvec.flat(texts)
        raw, off = np.append(data[off[0]:off[-1]], np.zeros(2, dtype=np.uint8)), off - off[0]
        if not off[-1]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(off), dtype=np.int64)
        begin = piece_begins(raw, off)
        coded = pa.Array.from_buffers(pa.large_string(), len(begin), [
            None, pa.py_buffer(np.append(begin, off[-1])), pa.py_buffer(raw)]).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        place = self.pieces.find(distinct).astype(np.int64)
        missed = np.flatnonzero(place < 0)
        new = distinct.take(pa.array(missed))
        size_new, ids_new = self.batch(new)
        held = len(self.pieces.size)
        place[missed] = held + np.arange(len(missed))
        size, ids = np.concatenate([self.pieces.size, size_new]), np.concatenate([self.pieces.ids, ids_new])
        at = np.cumsum(size) - size
        n = size[place][code]
        out = gather(ids, at[place][code], n)
        kept = np.flatnonzero(pc.less_equal(pc.binary_length(new), CACHE_CHARS).to_numpy(zero_copy_only=False))
        if len(kept):
            self.pieces.add(new.take(pa.array(kept)), size_new[kept], gather(ids, at[held + kept], size_new[kept]))
        return out, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, off)]

    def _parts(self, text: str) -> list[tuple[bool, str]]:
        """Runs of ``text``, and whether each holds added tokens."""
        if self.uncut:
            return [(True, text)]
        first, *rest = _SAFE.split(text)
        runs = groupby([first, *(" " + c for c in rest)], lambda c: any(s in c for s in self.special))
        return [(named, "".join(run)) for named, run in runs]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n+1 offsets of the texts (null counts as empty)."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string())
        hit = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            hit |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not hit.any():
            return self._plain(texts)
        rest = np.flatnonzero(~hit)
        row, plain, named, source = rest.tolist(), [], [], list(range(len(rest)))
        for i in np.flatnonzero(hit).tolist():
            for special, run in self._parts(texts[i].as_py()):
                row.append(i)
                if special:
                    source.append(-1 - len(named))
                    named.append(self.whole(run))
                else:
                    source.append(len(rest) + len(plain))
                    plain.append(run)
        ids, off = self._plain(pa.concat_arrays([texts.take(pa.array(rest)), pa.array(plain, type=pa.large_string())]))
        size = np.concatenate([np.diff(off), np.array([len(x) for x in named], dtype=np.int64)])
        ids = np.concatenate([ids, *[np.array(x, dtype="<u4") for x in named]])
        source = np.array(source, dtype=np.int64)
        source = np.where(source < 0, len(off) - 2 - source, source)[np.argsort(row, kind="stable")]
        n = size[source]
        total = np.zeros(len(texts) + 1, dtype=np.int64)
        np.add.at(total, np.sort(row) + 1, n)
        return gather(ids, (np.cumsum(size) - size)[source], n), np.cumsum(total)
