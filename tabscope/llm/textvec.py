"""Vectorised word hashing over the bytes of Arrow text batches (numpy).

A word is a run of bytes other than space and tab..carriage return; A-Z are
folded to a-z. Words and shingles become 64-bit hashes; work is done on slices
of about a megabyte so memory stays flat for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between runs of ASCII letters, digits and non-ASCII bytes.
MARK = np.ones(256, dtype=bool)
MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(256, 7)
_BYTE[65:91] = _BYTE[97:123]          # A-Z hash as a-z
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n (kept between calls)."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE + (1 << 16))
        inv = pow(_P, -1, 1 << 64)
        tables = []
        for base in (_P, inv):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POW[:] = tables
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def doc_slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes sum to about ``limit`` (a longer text is a range of its own)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of consecutive texts in one slice of bytes, hashed through prefix sums."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE):
        self.raw = raw
        n = len(raw)
        solid = ~gap[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        b = off[(off > 0) & (off < n)]                 # a word never crosses from text to text
        first[b] = solid[b]
        last[b - 1] = solid[b - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, off)    # word offsets of the texts
        pw, self.inv = _powers(n + 1)
        self.total = np.empty(n + 1, dtype=np.uint64)
        self.total[0] = 0
        np.cumsum(_BYTE[raw] * pw[:n], out=self.total[1:])

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        h = (self.total[ends] - self.total[self.starts]) * self.inv[self.starts]
        return mix(h + (ends - self.starts).astype(np.uint64))


def pieces(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of consecutive texts for ``Words``: one slice, or for one very long text several cut at gaps."""
    base, end = int(off[0]), int(off[-1])
    if end - base <= 2 * SLICE or len(off) > 2:
        yield raw[base:end], off - base
        return
    at = base
    while at < end:
        stop = min(at + SLICE, end)
        while stop < end:
            free = np.flatnonzero(gap[raw[at:stop]])
            if len(free):
                stop = at + int(free[-1]) + 1
                break
            stop = min(stop + SLICE, end)
        yield raw[at:stop], np.array([0, stop - at])
        at = stop


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts and the n+1 word offsets of the texts."""
    parts = [Words(r, o) for r, o in pieces(raw, off)]
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(off), dtype=np.int64)
    if len(parts) == 1:
        return parts[0].hashes(), parts[0].at
    h = np.concatenate([w.hashes() for w in parts])
    return h, np.array([0, len(h)], dtype=np.int64)


def shingle_set(w: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text (fewer words: the whole as one)."""
    n = len(w)
    if not n:
        return w
    size = min(k, n)
    x = mix(w[:n - size + 1] + np.uint64(size))
    for i in range(1, size):
        x = mix(x + w[i:n - size + 1 + i])
    x.sort()
    if len(x) > 1:
        keep = np.empty(len(x), dtype=bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        x = x[keep]
    return x


def text_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text in order."""
    raw, off = flat(texts)
    for i, j in doc_slices(off):
        h, wo = words(raw, off[i:j + 1])
        for d in range(j - i):
            yield shingle_set(h[wo[d]:wo[d + 1]], k)
