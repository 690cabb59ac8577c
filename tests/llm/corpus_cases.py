"""Small cases that all operators must handle, and the bundled tables."""

import pytest

SF001, SF01, SF1 = ("/root/testdata/sf" + x for x in ("0.001", "0.01", "0.1"))


def table(spark, name, sf):
    return spark.read.parquet(f"{sf}/{name}.parquet")


ODD = [(1, "the cat sat on the mat and the dog lay on the rug near the old door", "en"),
       (2, None, None), (3, "", "en"), (4, " \t\n ", "de"), (None, "der Hund und die Katze sind in dem Haus", "de"),
       (5, "the cat sat on the mat and the dog lay on the rug near the old door", "en"),
       (5, "the cat sat on the mat and the dog lay on the rug near the old door", "en"),
       (6, "word", None), (7, "12 34 !!", "en"), (8, "le chat et le chien " * 60_000, "fr")]
#: Extra columns whose names the operators use inside.
CLASH = ["ids", "n_tokens", "bucket", "rep", "g", "start", "key", "rk", "h", "root", "block", "features", "n"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(*r, *([0] * len(CLASH))) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASH))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
