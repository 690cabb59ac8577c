"""Top values and modes of long texts, of which many begin alike, against a plain count."""

import collections
import random

import pytest

from tabscope.operators import profile
from tabscope.plans import eda_report


def texts(seed):
    rng = random.Random(seed)
    heads = ["h" * 64, "h" * 63 + "g", "é" * 70, "a", "z" * 64]
    out = []
    for _ in range(120):
        t = rng.choice(heads) + "".join(rng.choice("ab\u0001") for _ in range(rng.choice([0, 1, 3])))
        out += [t] * rng.choice([1, 1, 1, 2, 3])
    rng.shuffle(out)
    return out


def ranked(values):
    return sorted(collections.Counter(values).items(), key=lambda x: (-x[1], x[0].encode()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_values_of_long_texts(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(profile, "LOOKUP_BROADCAST", 0)          # the lookup by a shuffle
    t, s = texts(seed), ["x", "y"]
    rows = [(v, s[i % 2], float(i)) for i, v in enumerate(t)]
    df = spark.createDataFrame(rows, "t string, s string, v double")
    want = ranked(t)
    for k in (1, 7, 20, 500):
        vc = profile.value_counts_long(df, ["t", "s"], compact=True)
        got = profile.top_of_each(df, vc, k).filter("column_name = 't'").orderBy("rank").collect()
        assert [(r["value"], r["count"]) for r in got] == want[:k]
    assert {r["column_name"]: r["mode"] for r in profile.column_modes(df, ["t", "s"]).collect()}["t"] == want[0][0]
    bars = {r["value"]: r["count"] for r in eda_report(df)["bars"].filter("column_name = 't'").collect()}
    exp = dict(want[:20])
    exp["Other"] = len(t) - sum(exp.values())
    assert bars == {k: n for k, n in exp.items() if n}


def test_modes_of_unique_long_texts(spark):
    t = ["p" * 100 + str(i) for i in range(50)]
    df = spark.createDataFrame([(x,) for x in reversed(t)], "t string")
    assert profile.column_modes(df, ["t"]).first()["mode"] == min(t)
    assert profile.column_modes(df.limit(0), ["t"]).count() == 0
