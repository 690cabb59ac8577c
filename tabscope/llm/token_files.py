"""Token ids in Parquet list columns that allow selective reads.

``write_tokens`` encodes every whole text, appends an end id, and writes the
documents in ascending ``doc_id`` order: one file per id range, ids as a
dictionary-encoded list column, numbers delta-encoded, small row groups and
pages with page indexes. A reader that needs the metadata, or a few documents,
reads those columns, row groups and pages only. ``read_tokens`` gives the
documents with ``start``, the number of ids of all documents before each.

Rows: a null text counts as empty (its only id is the end id); null ids come
first; rows that repeat a ``doc_id`` follow each other in the order of a hash of
the text, which also parts them between files. Extra columns are ignored. An empty table writes an empty folder with a schema.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .bpe import byte_letters
from .common import ship, shuffle_parts
from .pieces import PieceEncoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Parquet layout: bytes of a row group and a page, rows of a page.
LAYOUT = {"parquet.block.size": 16 << 20, "parquet.page.size": 128 << 10, "parquet.page.row.count.limit": 1000,
          "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
          "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20,
          "compression": "zstd"}

#: Pieces that a worker remembers.
CACHE_ENTRIES = 400_000
#: Letters that the library's merge model gets at once, at least.
BLOCK = 500

_LOADED: dict[str, PieceEncoder] = {}


def lone_byte(tok) -> int | None:
    """A byte that no UTF-8 text holds and no merge of the tokenizer takes in, so that it parts pieces; else none."""
    model, letters = tok.model, {b: c for c, b in byte_letters().items()}
    if model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges:
        return None
    vocab = tok.get_vocab(with_added_tokens=False)
    if any(c not in vocab for c in letters.values()):
        return None
    merged = set("".join(t for t in vocab if len(t) > 1))
    return next((b for b in (0xFF, 0xFE, 0xC0, 0xC1, *range(0xF5, 0xFE)) if letters[b] not in merged), None)


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's encoder of a file, loaded once per worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs one task per core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def whole(text: str) -> list[int]:
            return tok.encode(text, add_special_tokens=False).ids

        letters = {b: c for c, b in byte_letters().items()}
        letter = np.array([ord(letters[b]) for b in range(256)], dtype="<u2")
        model, token_id = tok.model, attrgetter("id")
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)                            # its own cache would meet each word once
        tokenize, barrier = model.tokenize, lone_byte(tok)

        def batch(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Pieces, as their byte letters, straight to the library's merge model, whole blocks at once if possible."""
            data, off = textvec.flat(pieces)
            if barrier is None:
                found = [list(map(token_id, tokenize(letter[data[a:z]].tobytes().decode("utf-16-le"))))
                         for a, z in zip(off[:-1], off[1:])]
                return (np.fromiter(map(len, found), dtype=np.int64, count=len(found)),
                        np.fromiter(chain.from_iterable(found), dtype="<u4"))
            text = letter[np.insert(data[off[0]:off[-1]], off[1:] - off[0], barrier)].tobytes().decode("utf-16-le")
            mark, ids, at = letters[barrier], [], 0
            while at < len(text):
                end = text.find(mark, at + BLOCK) + 1 or len(text)
                ids.extend(map(token_id, tokenize(text[at:end])))
                at = end
            ids = np.array(ids, dtype="<u4")
            marks = np.flatnonzero(ids == model.token_to_id(mark))
            return np.diff(marks, prepend=-1) - 1, np.delete(ids, marks)

        added = list(tok.get_added_tokens_decoder().values())
        uncut = any(t.lstrip or t.rstrip or t.single_word or t.normalized or " " in t.content for t in added)
        _LOADED[path] = PieceEncoder(batch, whole, [t.content for t in added], CACHE_ENTRIES, uncut)
    return _LOADED[path]


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file ``path`` and write the token files to ``out``."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        encoder = library_encoder(path)
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, ids, off in encoder.slices(b.column("text")):
                ids = np.insert(ids, off[1:], end_id).view("<i4")
                off = off + np.arange(len(off))                    # an end id after each text
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part, dtype=np.int32)),
                     pa.array(done + off[:-1]), pa.array(np.diff(off)),
                     pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), pa.array(ids))],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                done += int(off[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts or shuffle_parts(spark), *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of written token files; columns not asked for are not read."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    # one row per file range: the running total is over the parts, not over documents
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def ids_checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids`` replaced by the unsigned crc32 of the ids as little-endian uint32."""
    cols = [c for c in tokens.columns if c != "ids"]
    ship(tokens.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            off = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(flat[off[i]:off[i + 1]]) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(crc, type=pa.int64())],
                                             names=[*cols, "ids_crc32"])

    fields = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in cols)
    return tokens.mapInArrow(run, fields + ", ids_crc32 long")
