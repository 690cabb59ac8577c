"""Greedy word-piece token counts without building pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that continue one. A failure link leads from a node to where matching goes on
after the longest pieces of its string are popped, and the number of pieces
popped on that link is stored with it, so one walk over a word gives its count in
linear time. A word that cannot be covered counts as one unknown token.

Words are runs of letters, digits and marks; any other visible character is a
word of its own. The vocabulary comes from a sentencepiece model file (a
parameter): its pieces with a word mark begin words.

Rows: null and empty texts count 0; rows are independent; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _Cache
from .common import ship

#: Chunks a worker remembers (of one cache generation).
CACHE_ENTRIES = 200_000
WORD_MARK = "▁"
_WORDS = re.compile(r"\w+|[^\w\s]")
#: Field width in packed counts: tokens, unknown words and words of a text stay far below.
_FIELD = 42
_ONES = (1 << _FIELD) - 1


class WordPieceCounter:
    """``begin``: pieces that begin a word; ``go_on``: pieces that continue one (without marks)."""

    START, NEXT = 0, 1

    def __init__(self, begin: set[str], go_on: set[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        level: list[tuple[int, int, str]] = []            # (node, parent, character) in breadth-first order
        for root, pieces in ((self.START, begin), (self.NEXT, go_on)):
            for p in pieces:
                at = root
                for c in p:
                    to = self.child[at].get(c)
                    if to is None:
                        to = self.child[at][c] = len(self.child)
                        self.child.append({})
                        ends.append(False)
                    at = to
                if p:
                    ends[at] = True
        queue = [self.START, self.NEXT]
        for at in queue:
            for c, to in self.child[at].items():
                level.append((to, at, c))
                queue.append(to)
        self.fail = [-1] * len(self.child)                # -1: no way on
        self.popped = [0] * len(self.child)
        for node, parent, c in level:
            if ends[node]:
                self.fail[node], self.popped[node] = self.NEXT, 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0 and c not in self.child[at]:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.child[at][c], n

    def count(self, word: str) -> int:
        """Pieces of one word; -1 if it cannot be covered."""
        child, fail, popped = self.child, self.fail, self.popped
        at, n = self.START, 0
        for c in word:
            to = child[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = child[at].get(c)
            at = to
        while at > self.NEXT:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n

    def chunk(self, chunk: str) -> int:
        """Packed counts of a chunk without white space."""
        total = 0
        for w in _WORDS.findall(chunk):
            n = self.count(w)
            total += 1 << 2 * _FIELD | (1 | 1 << _FIELD if n < 0 else n)
        return total


_LOADED: dict[str, _Cache] = {}


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces of a sentencepiece model that begin and that continue words."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, go_on = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i)
        if p.startswith(WORD_MARK):
            begin.add(p[1:])
        else:
            go_on.add(p)
    return {p for p in begin if p and WORD_MARK not in p}, {p for p in go_on if WORD_MARK not in p}


def counter(path: str) -> _Cache:
    """Cached chunk counts over a model file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = _Cache(WordPieceCounter(*vocabulary(path)).chunk, CACHE_ENTRIES)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole ``text`` (an unknown word is one token)."""
    ship(docs.sparkSession)

    def run(batches):
        get = counter(path).__getitem__
        for b in batches:
            total = [sum(map(get, (t or "").split())) for t in b.column("text").to_pylist()]
            cols = ([x >> 2 * _FIELD for x in total], [x & _ONES for x in total],
                    [x >> _FIELD & _ONES for x in total])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, type=pa.int64()) for c in cols]],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
