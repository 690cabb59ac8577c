"""The corpus pipeline: quality, language, near-duplicates, decontamination, token ids.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; what it returns is
written as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``; the last adds the token ids and the
digest of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import bpe, decontam, language, minhash, quality
from tabscope.llm.common import cut, drop_table, read_table
from tabscope.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither junk nor abusive."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones."""
    return language.keep_identified(docs, language.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return minhash.keep_one_per_group(docs, shingle=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the digest of the text they decode to."""
    return bpe.encode(docs, vocabulary(), keep=docs.columns, arrays=True, decoded=True)


STAGES = [("quality", good_quality), ("language", known_language), ("near_dedup", one_of_each),
          ("decontamination", decontaminated), ("bpe", encoded)]

#: No SQL: the first two stages train models. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        written: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), f"stage_{name}", written)
        for path in before:
            drop_table(spark, path)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
