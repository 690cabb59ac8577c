"""Tables of 0 to 9 rows, infinite values and Unicode blanks."""

import math

import numpy as np
import pytest

from tabscope.functions.stats import _lerp, quantiles
from tabscope.operators import chartdata, iforest, outliers, profile, transform
from tabscope.plans import reports

INF = math.inf


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 8, 9])
def test_reports_of_tiny_tables(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
    r = reports.column_report(df, "v").first()
    assert r["missing"] == 0 and (r["p_value"] is None) == (n <= 8)
    t = profile.normality_test(df).first()
    assert t["n"] == n and (t["statistic"] is None) == (n <= 8)


def test_quantiles_with_infinite_values(spark):
    rows = [(1.0, -INF, 2.0), (INF, 1.0, -INF), (INF, INF, INF), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    q = quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 1.0])
    assert [q[(None, "a", p)] for p in (0.0, 0.25, 0.5, 1.0)] == [1.0, INF, INF, INF]
    assert [q[(None, "b", p)] for p in (0.0, 0.25, 0.5, 1.0)] == [-INF, -INF, 1.0, INF]
    assert [q[(None, "c", p)] for p in (0.0, 0.5, 1.0)] == [-INF, 2.5, INF]
    assert math.isnan(_lerp(-INF, INF, 0.5)) and _lerp(2.0, 2.0, 0.3) == 2.0


def test_charts_and_flags_with_infinite_values(spark):
    vals = [float(i % 10) for i in range(200)] + [INF, -INF, INF, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    hist = chartdata.histogram(df, "v", 10).collect()
    assert [r["count"] for r in hist] == [20] * 10
    kde = chartdata.kde_curve(df, "v").collect()
    assert len(kde) == 200 and all(math.isfinite(r["density"]) for r in kde)
    flags = {r["v"]: r["is_iforest"] for r in iforest.isolation_forest_flags(df, "v").collect()}
    assert flags[INF] and flags[-INF] and not flags[None]
    assert sorted(r["value"] for r in outliers.outliers_iqr(df, "v").collect()) == [-INF, INF, INF]
    with pytest.raises(ValueError, match="infinite"):
        transform.bin_equal_width(df, "v", 5, "b")
    mostly = spark.createDataFrame([(INF,)] * 5 + [(1.0,)], "v double")
    assert outliers.outliers_iqr(mostly, "v").count() == 0          # quartiles are infinite: no fence
    assert reports.column_report(df, "v").first()["missing"] == 1


def test_kde_reaches_all_it_must(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), [500.0, 501.0]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    bw = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
    got = [r["density"] for r in chartdata.kde_curve(df, "v", exact=True).collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-15)


def test_blanks_are_those_of_python(spark):
    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, c + "x" + c) for i, c in enumerate(chars)], "i long, t string")
    got = {r["i"]: r["s"] for r in df.select("i", outliers.strip_ws(df["t"]).alias("s")).collect()}
    assert got == {i: (c + "x" + c).strip() for i, c in enumerate(chars)}


@pytest.mark.parametrize("accuracy,bracket,gather", [(10_000, 200_000, 2_000_000), (100, 5, 12), (100, 40, 60), (300, 3, 3)])
def test_quantiles_of_hard_columns(spark, accuracy, bracket, gather):
    """Ties that hold most rows, two heavy values with few between, long tails, infinities; narrow brackets and budgets."""
    rng = np.random.default_rng(accuracy + bracket)
    n = 4000
    two = np.where(np.arange(n) < 1990, 1.0, 2.0)
    two[1985:2015] = rng.uniform(1, 2, 30)
    cols = {"tie": np.where(rng.random(n) < 0.9, 3.0, rng.normal(size=n)), "two": two, "tail": rng.pareto(0.3, n),
            "inf": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)), "int": rng.integers(0, 50, n).astype(float),
            "some": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n))}
    names = list(cols)
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    probs = [0.0, 0.001, 0.25, 0.4975, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, names, probs, accuracy=accuracy, max_bracket=bracket, max_gather=gather)
    for c in names:
        v = np.sort(cols[c][~np.isnan(cols[c])])
        for p in probs:
            h = (len(v) - 1) * p
            k = int(math.floor(h))
            want = _lerp(float(v[k]), float(v[min(math.ceil(h), len(v) - 1)]), h - k)
            assert got[(None, c, p)] == want or got[(None, c, p)] == pytest.approx(want, rel=1e-12), (c, p)
