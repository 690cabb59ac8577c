"""The Pareto summary's selection against a sorted running sum."""

import pytest

from tabscope.operators import segment


def brute(values, threshold):
    order, grand, run, top = sorted(values, reverse=True), sum(values), 0, []
    for v in order:
        run += v
        top.append(run * 100 <= threshold * grand)
    out = {}
    for v, t in zip(order, top):
        n, s = out.get("Top" if t else "Bottom", (0, 0))
        out["Top" if t else "Bottom"] = (n + 1, s + v)
    return out


CASES = {"ties": [5] * 4000 + [1] * 300, "spread": [2 ** (i % 40) + i for i in range(3000)],
         "negative": [100, 50, 25, 0, 0, -10, -20], "one": [7], "all_negative": [-1, -2], "zero_sum": [4, -4],
         "hot": [10 ** 9] + [1] * 2000, "close": [10 ** 9 + i for i in range(3000)]}


@pytest.mark.parametrize("last", [1, segment.LAST])
@pytest.mark.parametrize("name", CASES)
def test_summary(spark, monkeypatch, name, last):
    monkeypatch.setattr(segment._split_at, "__defaults__", (last,))
    df = spark.createDataFrame(list(enumerate(CASES[name])), "id int, v long")
    for threshold in (80.0, 0.0, 33.0):
        got = {r["segment"]: (r["entities"], r["value"]) for r in
               segment.pareto_split(df, "id", "v", threshold).collect()}
        if sum(CASES[name]) == 0:
            assert got == {"Top": (2, 0.0)}                      # every share counts as 0
        else:
            want = brute(CASES[name], threshold)
            if sum(CASES[name]) < 0:
                grand, run, want = sum(CASES[name]), 0, {}
                for v in sorted(CASES[name], reverse=True):
                    run += v
                    side = "Top" if run / grand * 100 <= threshold else "Bottom"
                    n, s = want.get(side, (0, 0))
                    want[side] = (n + 1, s + v)
            assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
            assert {k: v for k, (_, v) in got.items()} == pytest.approx({k: v for k, (_, v) in want.items()})


def test_empty(spark):
    df = spark.createDataFrame([], "id int, v long")
    assert segment.pareto_split(df, "id", "v").count() == 0
