"""The pipeline's stages on a small table: columns, decisions and brute force."""

import corpus_pipeline
from corpus_cases import SF01, table
from test_groups import best_windows, components

from tabscope.llm import bpe, queries


def test_stages_decide_and_keep_clean_documents(spark):
    docs = table(spark, "documents", SF01)
    labels = {r["doc_id"]: r for r in table(spark, "labels", SF01).collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark", SF01).collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF01)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept["quality"] for i in clean) / len(clean) > 0.99
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in kept["quality"] for i in bad) / len(bad) < 0.1
    assert len(kept["language"]) > 0.99 * len(kept["quality"])
    groups = components(kept["language"].items(), 5, 80)
    assert set(kept["near_dedup"]) == {i for i, g in groups.items() if g[2]}
    leaks = {d for d, _ in best_windows(kept["near_dedup"].items(), items)}
    assert leaks and set(kept["decontamination"]) == set(kept["near_dedup"]) - leaks
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF01).collect()
    own = bpe.ByteBPE(queries.vocabulary())
    assert {r["doc_id"]: len(r["token_ids"]) for r in coded} == {
        i: len(own.encode(t)) // 4 for i, t in kept["decontamination"].items()}
