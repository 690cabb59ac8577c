"""Periodic runs of words, found through a run-length grammar made by recompression.

The words of a text are symbols. Level by level, blocks of one symbol are merged
(block compression), then pairs whose first symbol is on the left side and whose
second is on the right side of a partition of the symbols (pair compression; the
sides are a hash bit of the level, the direction is the one that covers more),
until each text is one symbol. Equal words in equal surroundings get equal
symbols, so two positions are compared by climbing while whole phrases are equal
and descending where they differ: an extension (LCE query) takes a few steps a
level, forwards or backwards. Blocks are skipped as a whole.

A run of period q and length 4 q or more (6 or more for q = 1) holds a pair of
equal words q apart at one of the places 0, 3 q, 6 q, ... (0, 5, 10, ... for
q = 1): the harmonic grid. Every such pair is extended both ways by exact LCE
queries. Of several periods with the same extent the smallest is kept, which is
the run's smallest period (a run of length 4 q with a smaller period is found
with that period, too).

Work is done on slices of about a megabyte of text; a longer text is a slice of
its own (about 35 bytes of memory a byte), candidates in blocks of a quarter of a million.

Rows: a null, empty or blank text has no word, no run and an empty collapsed
text. Rows are independent, so repeated rows and ids give repeated results and a
null id stays null. Extra columns are dropped unless named in ``keep``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import ship

#: A run has at least this many words, and its period this many times.
LEAST, TIMES = 6, 4
#: Candidates extended at once.
CHUNK = 1 << 18


class Grammar:
    """Run-length grammar of a sequence of symbols below zero (never merged) and from zero on.

    Symbols of all levels are numbered one after another, so level 0 has the places
    of the sequence. ``name`` tells symbols of one level apart, ``up`` is a symbol's
    parent (-1 on the last level), ``first`` its first child (level 0: itself), the
    next symbol's first child ends its own; ``block`` says whether block compression
    made it. The first and the last symbol of the sequence must be below zero.
    """

    def __init__(self, symbols: np.ndarray):
        names = symbols.astype(np.int32)
        levels, firsts, ups, blocks = [names], [np.arange(len(names), dtype=np.int32)], [], [False]
        base, rounds = 0, 0
        while ((names[1:] >= 0) & (names[:-1] >= 0)).any():
            block = rounds % 2 == 0
            head = self._block_heads(names) if block else self._pair_heads(names, rounds)
            rounds += 1
            if head.all():                                    # no block, or this coin parts no pair
                continue
            kids = np.flatnonzero(head)
            ups.append((np.cumsum(head) - 1 + base + len(names)).astype(np.int32))
            size = np.diff(np.append(kids, len(names)))
            left = names[kids]
            right = size if block else np.where(size == 2, names[np.minimum(kids + 1, len(names) - 1)], -1)
            firsts.append((kids + base).astype(np.int32))
            base += len(names)
            names = self._renamed(left, right)
            levels.append(names)
            blocks.append(block)
        ups.append(np.full(len(names), -1, dtype=np.int32))
        self.low = len(symbols)
        self.block = np.repeat(blocks, [len(x) for x in levels])
        self.name, self.first, self.up = np.concatenate(levels), np.concatenate(firsts), np.concatenate(ups)

    @staticmethod
    def _block_heads(names: np.ndarray) -> np.ndarray:
        head = np.ones(len(names), dtype=bool)
        head[1:] = (names[1:] != names[:-1]) | (names[1:] < 0)
        return head

    @staticmethod
    def _pair_heads(names: np.ndarray, rounds: int) -> np.ndarray:
        side = (textvec.mix(names.astype(np.uint64) + np.uint64(rounds * 0x9E3779B97F4A7C15 % (1 << 64)))
                & np.uint64(1)).astype(bool)
        free = names >= 0
        both = free[:-1] & free[1:]
        forth, back = side[:-1] & ~side[1:] & both, ~side[:-1] & side[1:] & both
        head = np.ones(len(names), dtype=bool)
        head[1:] = ~(forth if forth.sum() >= back.sum() else back)
        return head

    @staticmethod
    def _renamed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One number per distinct (left, right); symbols below zero keep theirs."""
        free = left >= 0
        out = left.copy()
        width = int(right.max(initial=0)) + 2
        _, out[free] = np.unique(left[free].astype(np.int64) * width + right[free] + 1, return_inverse=True)
        return out

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from level-0 places ``i < j`` on."""
        x, y, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        todo, climb = np.arange(len(i)), np.ones(len(i), dtype=bool)
        while len(todo):
            a, b = x[todo], y[todo]
            equal = self.name[a] == self.name[b]
            ended = ~equal & (a < self.low)
            out[todo[ended]] = a[ended] - i[todo[ended]]
            down = ~equal & ~ended
            at = todo[down]
            x[at], y[at], climb[at] = self.first[a[down]], self.first[b[down]], False
            at, a, b = todo[equal], a[equal], b[equal]
            u, v = self.up[a], self.up[b]
            rise = climb[at] & (u >= 0) & (self.first[u] == a) & (self.first[v] == b) & (self.name[u] == self.name[v])
            skip = np.where((u >= 0) & self.block[u], np.minimum(self.first[u + 1] - a, self.first[v + 1] - b), 1)
            x[at], y[at] = np.where(rise, u, a + skip), np.where(rise, v, b + skip)
            todo = todo[~ended]
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before level-0 places ``i < j``."""
        x, y, out = i - 1, j - 1, np.zeros(len(i), dtype=np.int64)
        todo, climb = np.arange(len(i)), np.ones(len(i), dtype=bool)
        while len(todo):
            a, b = x[todo], y[todo]
            equal = self.name[a] == self.name[b]
            ended = ~equal & (a < self.low)
            out[todo[ended]] = i[todo[ended]] - a[ended] - 1
            down = ~equal & ~ended
            at = todo[down]
            x[at], y[at], climb[at] = self.first[a[down] + 1] - 1, self.first[b[down] + 1] - 1, False
            at, a, b = todo[equal], a[equal], b[equal]
            u, v = self.up[a], self.up[b]
            rise = climb[at] & (u >= 0) & (self.first[u + 1] == a + 1) & (self.first[v + 1] == b + 1) & (self.name[u] == self.name[v])
            skip = np.where((u >= 0) & self.block[u], np.minimum(a - self.first[u], b - self.first[v]) + 1, 1)
            x[at], y[at] = np.where(rise, u, a - skip), np.where(rise, v, b - skip)
            todo = todo[~ended]
        return out


def _grid(begin: np.ndarray, size: np.ndarray):
    """Harmonic-grid candidates ``(place, period)`` of texts at ``begin`` with ``size`` words, in blocks."""
    most = np.where(size >= LEAST, np.maximum(size // TIMES, 1), 0)     # longest period of each text
    total = np.concatenate([[0], np.cumsum(most)])
    at = 0
    while at < total[-1]:
        # candidates of a (text, period): as many as grid places that leave room for the pair
        upto = min(at + CHUNK, int(total[-1]))
        pair = np.arange(at, upto)
        text = np.searchsorted(total, pair, side="right") - 1
        period = pair - total[text] + 1
        gap = np.maximum(LEAST, TIMES * period) - period
        places = (size[text] - period + gap - 1) // gap
        room = np.cumsum(places)
        fit = max(1, int(np.searchsorted(room, CHUNK, side="right")))
        text, period, gap, places = text[:fit], period[:fit], gap[:fit], places[:fit]
        at += fit
        nth = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        yield np.repeat(begin[text], places) + nth * np.repeat(gap, places), np.repeat(period, places)


def find_runs(symbols: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)``, by start then period, of consecutive texts of symbols (from zero on)."""
    n = len(off) - 1
    size = np.diff(off)
    # a mark of its own before each text and at the end: no extension leaves its text
    place = off[:-1] + np.arange(n) + 1
    line = np.full(len(symbols) + n + 1, -1, dtype=np.int64)
    inside = np.ones(len(line), dtype=bool)
    inside[np.append(place - 1, len(line) - 1)] = False
    line[~inside] = -1 - np.arange(n + 1)
    line[inside] = symbols
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    grammar, found = None, []
    for i, q in _grid(place, size):
        same = line[i] == line[i + q]
        i, q = i[same], q[same]
        if not len(i):
            continue
        grammar = grammar or Grammar(line)
        ahead, behind = grammar.forwards(i, i + q), grammar.backwards(i, i + q)
        long = ahead + behind + q >= np.maximum(LEAST, TIMES * q)
        if long.any():
            found.append(np.stack([(i - behind)[long], (i + ahead + q)[long], q[long]]))
    if not found:
        return out
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), dtype=bool)                     # of one extent the smallest period
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    text = np.searchsorted(place, start, side="right") - 1
    for k in order.tolist():
        t = int(text[k])
        out[t].append((int(start[k] - place[t]), int(end[k] - start[k]), int(period[k])))
    return out


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after the run's first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def periodic_runs(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` of every whole ``text``.

    ``collapsed`` is the words, joined by one space, without the repeats of every run.
    """
    keep = list(keep)
    ship(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            raw, bounds = textvec.flat(b.column("_text"))
            for i, j in textvec.doc_slices(bounds):
                part = b.slice(i, j - i)
                # on bytes: words end at ASCII white space only
                words = [raw[bounds[d]:bounds[d + 1]].tobytes().split() for d in range(i, j)]
                number = defaultdict(count().__next__)          # word -> symbol
                lengths = [len(own) for own in words]
                off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                symbols = np.fromiter((number[w] for own in words for w in own), dtype=np.int64, count=int(off[-1]))
                runs = find_runs(symbols, off)
                kept = []
                for own, found in zip(words, runs):
                    if found:
                        gone = repeated(len(own), found).tolist()
                        own = [w for w, out in zip(own, gone) if not out]
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(lengths, type=pa.int64()),
                     pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs],
                              type=run_type), pa.array(kept, type=pa.binary()).cast(pa.string())],
                    names=[*keep, "n_words", "runs", "collapsed"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(
        run, fields + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
