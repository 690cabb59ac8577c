"""The pipeline's last stage decodes what it has encoded."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from corpus_cases import odd  # noqa: F401


def test_last_stage_returns_the_digest_of_the_decoded_text(spark, odd):  # noqa: F811
    docs = odd.withColumn("Token_IDs", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("_n_tokens", F.lit(3))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    moved = {"n_tokens": "__n_tokens", "Token_IDs": "_Token_IDs"}          # own columns with a result's name
    assert out.columns == [*[moved.get(c, c) for c in docs.columns], "n_tokens", "token_ids", "decoded_sha256"]
    assert {tuple(r) for r in out.select("__n_tokens", "_Token_IDs", "_text", "_n_tokens").collect()} == {(0, 1, 2, 3)}
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert len(r["token_ids"]) == r["n_tokens"]
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
