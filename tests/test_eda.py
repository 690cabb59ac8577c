"""The fused exploratory plan must agree with the single-chart operators."""

import pytest

from conftest import table
from tabscope.operators import chartdata, profile, relations
from tabscope.plans import eda_report


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def ev_parts(spark):
    return table(spark, "events"), eda_report(table(spark, "events"))


def test_histograms_and_boxes(ev_parts):
    ev, parts = ev_parts
    for c in ["event_id", "user_id", "value"]:
        fused = parts["histograms"].filter(f"column_name = '{c}'")
        assert _rows(fused, "bin", "count") == _rows(chartdata.histogram(ev, c), "bin", "count")
        box = parts["box_stats"].filter(f"column_name = '{c}'").first()
        single = chartdata.box_stats(ev, c).first()
        for k in ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers"]:
            assert box[k] == pytest.approx(single[k])


def test_numeric_summary_and_pairs(ev_parts):
    ev, parts = ev_parts
    a = {r["column_name"]: r for r in parts["numeric_summary"].collect()}
    b = {r["column_name"]: r for r in profile.numeric_summary_all(ev).collect()}
    for c in b:
        for k in ["mean", "median", "min", "max"]:
            assert a[c][k] == pytest.approx(b[c][k])
    fused = [(r["col_a"], r["col_b"]) for r in parts["top_corr_pairs"].collect()]
    single = [(r["col_a"], r["col_b"]) for r in relations.top_corr_pairs(ev).collect()]
    assert fused == single
    for r in parts["trends"].collect():
        t = relations.ols_trend(ev, r["x"], r["y"]).first()
        assert r["slope"] == pytest.approx(t["slope"]) and r["n"] == t["n"]


def test_bars_pies_and_groups(spark, ev_parts):
    ev, parts = ev_parts
    bars = _rows(parts["bars"].filter("column_name = 'props'"), "value", "count")
    assert bars == _rows(profile.topn_other(ev, "props", 20), "value", "count")
    pie = _rows(parts["pies"].filter("column_name = 'props'"), "value", "count")
    assert pie == _rows(profile.pie_shares(ev, "props", 10), "value", "count")
    by_cat = parts["box_by_category"].filter("column_name = 'value'")
    single = chartdata.box_stats_by_category(ev, "event_type", "value")
    assert _rows(by_cat, "category", "n", "fliers") == _rows(single, "category", "n", "fliers")
    gm = {r["category"]: r["value"] for r in parts["group_means"].collect()}
    ref = {r["event_type"]: r["value"] for r in relations.group_means(ev, "event_type").collect()}
    assert gm.keys() == ref.keys() and all(gm[k] == pytest.approx(ref[k]) for k in ref)
    assert parts["facets"].groupBy().sum("count").first()[0] == ev.count()


def test_part_table_collapses_facets(spark):
    parts = eda_report(table(spark, "part"))
    facet_col = parts["facets"].first()["facet_column"]
    assert facet_col == "p_type"
    assert "numeric_summary" in parts and "bars" in parts


def test_one_click_equals_standalone_reports(spark):
    from tabscope.plans import audit_report, cleaning_suggestions, eda_findings, insights_report
    from tabscope.plans.reports import one_click_findings
    ev = table(spark, "events")

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    combined = rows(one_click_findings(ev).filter("check NOT IN ('daily_points', 'daily_mean')"))
    parts = (audit_report(ev).unionByName(insights_report(ev)).unionByName(cleaning_suggestions(ev))
             .unionByName(eda_findings(ev)))
    assert combined == rows(parts)


def test_approx_quantile_option_runs_in_one_pass(spark):
    from tabscope.plans import audit_report
    ev = table(spark, "events")
    exact = sorted(map(tuple, audit_report(ev).collect()), key=str)
    approx = sorted(map(tuple, audit_report(ev, quantile_method="approx").collect()), key=str)
    assert exact == approx          # below the sketch's accuracy the approximation is exact
    parts = eda_report(ev, quantile_method="approx")
    assert parts["box_stats"].count() == 3
