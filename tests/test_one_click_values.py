"""The one-click query reads every value column of the report's tables."""

import __spark_entry__ as E
from conftest import SF001
from tabscope.plans import reports


def test_every_number_of_the_tables_is_summed(spark):
    rep = reports.one_click_report(E._t(spark, SF001, "events"))
    parts = {n: d for n, d in (rep["eda"] | rep["time"]).items() if n in E.ONE_CLICK_VALUES}
    assert set(parts) == set(E.ONE_CLICK_VALUES)
    places = {"bin", "bin_x", "bin_y", "rank", "month", "weekday", "phase"}
    for name, df in parts.items():
        numbers = {c for c, t in df.dtypes if t in ("double", "bigint", "int")} - places
        assert numbers == set(E.ONE_CLICK_VALUES[name]), name
    query = E.queries()["one_click_values"](spark, SF001)
    assert query.count() == sum(map(len, E.ONE_CLICK_VALUES.values()))
