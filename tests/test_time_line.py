"""The time line holds all rows in order of time at the chosen grain."""

import datetime as dt

import pytest

from tabscope.operators import timeseries


def test_time_line_at_each_grain(spark):
    at = [dt.datetime(2024, 3, 31, h, m) for h in (0, 1, 2, 3) for m in (5, 59)] + [dt.datetime(2024, 2, 1, 7, 30)]
    rows = [(t, float(i)) for i, t in enumerate(at)] + [(None, 9.0), (dt.datetime(2024, 4, 1, 8, 0), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    hour = timeseries.time_line(df, "t", "v").collect()
    assert [r["time"] for r in hour] == [dt.datetime(2024, 2, 1, 7), *[dt.datetime(2024, 3, 31, h) for h in range(4)],
                                         dt.datetime(2024, 4, 1, 8)]
    assert [(r["mean"], r["min"], r["max"], r["n"]) for r in hour][1] == (0.5, 0.0, 1.0, 2)
    assert hour[-1]["n"] == 0 and hour[-1]["mean"] is None
    sizes = {g: [r["n"] for r in timeseries.time_line(df, "t", "v", g).collect()] for g in ("minute", "day", "week", "month")}
    assert sizes == {"minute": [1] * 9 + [0], "day": [1, 8, 0], "week": [1, 8, 0], "month": [1, 8, 0]}
    with pytest.raises(ValueError):
        timeseries.time_line(df, "t", "v", "decade")
