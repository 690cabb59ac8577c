"""Every suffix has a block rate of its own, however many there are."""

from pyspark.sql import functions as F

from tabscope.llm import urls


def test_rare_suffixes_keep_their_rates(spark):
    rows = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("host_suffix"),
                                    (F.col("id") % 1500 % 2).cast("double").alias("label"))
    got = {r[0]: r[1] for r in urls._rates(rows, "host_suffix", 0.5).collect()}
    assert got == {str(i): (2 * (i % 2) + 0.5 * urls.PRIOR_ROWS) / (2 + urls.PRIOR_ROWS) for i in range(1500)}


def test_verdicts_do_not_depend_on_how_rates_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.t{i % 90}/{'es' if i % 2 else 'p'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://k.t{i}/zz/{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block" if i % 2 else "allow", f"t{i}/{'es' if i % 2 else 'p'}/") for i in range(90)]
    small = sorted(tuple(r) for r in urls.judge(df, rules).collect())
    monkeypatch.setattr(urls, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in urls.judge(df, rules).collect()) == small and len(small) == 490


def test_file_suffixes_of_any_length(spark):
    df = spark.createDataFrame([(1, "http://a.b/x.longextension9"), (2, "http://a.b/x.gz"), (3, "http://a.b/x"), (4, None)],
                               "page_id long, url string")
    got = {r[0]: r[1] for r in urls._lexical(urls.parts(df)).select("page_id", "file_suffix").collect()}
    assert got == {1: "longextension9", 2: "gz", 3: "", 4: ""}
