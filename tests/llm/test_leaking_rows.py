"""Only the leaking rows go, also where ids are null, repeated or the row hash is shared."""

from pyspark.sql import functions as F

from tabscope.llm import decontam

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def table(spark):
    rows = [(1, PASSAGE), (1, "quite another text of the same id with many more words in it"), (None, "x " + PASSAGE),
            (None, "a harmless text"), (None, None), (2, ""), (3, PASSAGE + " and more")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row_key": F.lit(5), "_row_id": F.lit(6)})


def test_leaking_rows_go(spark):
    bench = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    docs = table(spark)
    out = decontam.drop_leaking(docs, bench)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, [
        (1, "quite another text of the same id with many more words in it"), (None, "a harmless text"),
        (None, None), (2, "")]))


def test_a_shared_row_key_drops_no_other_document(spark, monkeypatch):
    bench = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    docs = table(spark)
    leaks = decontam._find(decontam._keyed(docs), bench, 5, 80, 100).filter("doc_id = 1").limit(1)
    other = docs.filter("doc_id = 2").select(F.xxhash64("doc_id", "text")).first()[0]
    monkeypatch.setattr(decontam, "_find", lambda *a: leaks.withColumn("rk", F.lit(other)))
    assert decontam.drop_leaking(docs, bench).count() == docs.count()
