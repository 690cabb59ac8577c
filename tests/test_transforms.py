"""Semantics of the column transforms and detectors on small in-code tables."""

import datetime as dt

import pytest

from tabscope.operators import detect, profile, transform
from tabscope.sources import readers


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_drop_and_name_checks(spark):
    df = frame(spark, [(1, 2.0)], "a bigint, b double")
    assert transform.drop_columns(df, ["b"]).columns == ["a"]
    with pytest.raises(KeyError):
        transform.drop_columns(df, ["zz"])
    with pytest.raises(ValueError):
        transform.derive_numeric(df, "a", "+", "b", "b")
    with pytest.raises(ValueError):
        transform.bin_equal_width(df, "b", 3, "a")


def test_ratio_adds_epsilon(spark):
    df = frame(spark, [(0.0, 0.0), (1.0, 0.0), (4.0, 2.0)], "a double, b double")
    got = [r["r"] for r in transform.derive_numeric(df, "a", "/", "b", "r").collect()]
    assert got == [0.0, pytest.approx(1e9), pytest.approx(2.0)]


def test_datetime_parts(spark):
    df = frame(spark, [(dt.datetime(2024, 12, 30, 10, 0),), (None,)], "t timestamp_ntz")
    r = transform.datetime_parts(df, "t").collect()[0]
    assert (r["t_year"], r["t_month"], r["t_day"], r["t_quarter"]) == (2024, 12, 30, 4)
    assert (r["t_day_of_week"], r["t_day_name"], r["t_week_of_year"]) == (0, "Monday", 1)
    text = frame(spark, [("05/01/2024",), ("12/31/2023",), ("bad",)], "d string")
    parts = transform.datetime_parts(text, "d", ["Year", "Month"]).collect()
    assert [(p["d_year"], p["d_month"]) for p in parts] == [(2024, 5), (2023, 12), (None, None)]


def test_convert_types_and_report(spark):
    df = frame(spark, [(" 12 ",), ("x",), (None,), ("1e3",)], "s string")
    assert [r[0] for r in transform.convert_type(df, "s", "numeric").collect()] == [12.0, None, None, 1000.0]
    assert transform.conversion_report(df, "s", "numeric").first()["newly_missing"] == 1
    assert [r[0] for r in transform.convert_type(df, "s", "int").collect()] == [12, None, None, None]
    dates = frame(spark, [("2024-01-05",), ("Jan 6 2024",), ("nope",)], "d string")
    best = [r[0] for r in transform.convert_type(dates, "d", "datetime").collect()]
    assert best[0] == dt.datetime(2024, 1, 5) and best[1] is None and best[2] is None
    mixed = [r[0] for r in transform.convert_type(dates, "d", "datetime", mixed=True).collect()]
    assert mixed[:2] == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)] and mixed[2] is None
    with pytest.raises(ValueError):
        transform.convert_type(dates, "d", "complex")


def test_category_codes_and_collapse(spark):
    df = frame(spark, [("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    codes = [tuple(r) for r in transform.category_codes(df, "s").collect()]
    assert sorted(codes, key=lambda t: (t[0] is None, t[0] or "")) == [
        ("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, -1)]
    assert transform.collapse_rare(df, "s", 3).filter("s = 'Other'").count() == 0
    collapsed = [r[0] for r in transform.collapse_rare(df, "s", 1).collect()]
    assert collapsed == ["Other", "a", "Other", "Other", "a"]


def test_fill_and_impute(spark):
    df = frame(spark, [(1, 1.0, "x"), (2, None, None), (3, 3.0, "y"), (4, 10.0, "y")],
               "id bigint, v double, s string")
    assert transform.handle_missing(df, "v", "mean").filter("id = 2").first()["v"] == pytest.approx(14 / 3)
    assert transform.handle_missing(df, "v", "median").filter("id = 2").first()["v"] == 3.0
    assert transform.handle_missing(df, "s", "mode").filter("id = 2").first()["s"] == "y"
    assert transform.handle_missing(df, "v", "constant", "7").filter("id = 2").first()["v"] == 7.0
    assert transform.handle_missing(df, "v", "drop").count() == 3
    with pytest.raises(ValueError):
        transform.handle_missing(df, "id", "constant", "abc")
    with pytest.raises(ValueError):
        transform.handle_missing(df, "v", "constant", None)


def test_standardize_and_filter_top(spark):
    df = frame(spark, [("USA",), ("United States",), ("FR",), ("USA",)], "c string")
    out = [r[0] for r in transform.standardize_categories(df, "c", ["United States"], "USA").collect()]
    assert out == ["USA", "USA", "FR", "USA"]
    assert transform.filter_top_categories(df, "c", 1).count() == 2


def test_detectors_on_names(spark):
    df = frame(spark, [(1, "2024-01-01", "a", 5.0), (2, "2024-01-02", "b", 7.0)],
               "width bigint, order_date string, kind string, sales double")
    # 'width' contains 'id' (substring rule kept on purpose)
    assert detect.id_column_name(df) == "width"
    assert detect._first(detect.detect_time_column(df)) == "order_date"
    ts = detect.detect_ts_columns(df).first()
    assert (ts["time_column"], ts["value_column"]) == ("order_date", "sales")
    assert detect._first(detect.detect_value_column(df)) == "sales"
    bad = frame(spark, [("2024-01-01",), ("later",)], "event_time string")
    inv = detect.invalid_dates(bad).first()
    assert inv["column_name"] == "event_time" and inv["failing_values"] == 1


def test_unsupported_format_raises(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/tmp/table.xlsx")
