"""Time spans, stamps, widths, and small functions."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newslens.functions import scalars, times
from newslens.operators import articles, timelines


@pytest.mark.parametrize("given, want", [("7", "7d"), (" 2 Weeks ", "2w"), ("1mo", "1m"), ("24hr", "24h"), ("15mins", "15min"), ("1minute", "1minute"), ("2y", "2y"), ("soon", "soon"), (3, "3d"), ("", "")])
def test_parse_timespan(given, want):
    assert times.parse_timespan(given) == want


def test_intervals():
    assert times.interval_sql("2y") == "INTERVAL 2 YEAR" and times.interval_sql("1 minute") == "INTERVAL 1 MINUTE" and times.interval_sql("1m") == "INTERVAL 1 MONTH"
    with pytest.raises(ValueError):
        times.interval_sql("soon")


@pytest.mark.parametrize("hours, want", [(71.9, "15min"), (72, "hour"), (168, "hour"), (168.1, "day")])
def test_resolution(hours, want):
    assert times.resolution(timedelta(hours=hours)) == want


def test_precedence_and_clamp():
    assert times.effective_timespan(None, 0) == "0d"
    assert times.effective_timespan("3 weeks", 5) == "3w" and times.effective_timespan("", 5) == "5d" and times.effective_timespan(None, None) == "7d"
    assert times.clamped("2w", "geo") == "168h" and times.clamped("2d", "geo") == "2d" and times.clamped("9y", "tv") == "9y"


def test_stamps(spark):
    df = spark.createDataFrame([("20260224T163000Z",), ("2026-02-24",), ("",), (None,), ("20261324T163000Z",)], "s string")
    assert [str(r[0]) if r[0] else None for r in df.select(times.parse_stamp(F.col("s"))).collect()] == ["2026-02-24 16:30:00", None, None, None, None]


def test_tone_label(spark):
    df = spark.createDataFrame([(2.1,), (2.0,), (0.0,), (-1.9,), (-2.0,), (float("nan"),), (None,)], "t double")
    assert [r[0] for r in df.select(scalars.tone_label(F.col("t"))).collect()] == ["POSITIVE", "SLIGHTLY POSITIVE", "SLIGHTLY NEGATIVE", "SLIGHTLY NEGATIVE", "NEGATIVE", "NEGATIVE", None]


def test_whole(spark):
    df = spark.createDataFrame([("3.9",), ("-3.9",), ("x",), (None,), ("1e3",)], "v string")
    assert [r[0] for r in df.select(scalars.whole(F.col("v"))).collect()] == [3, -3, None, None, 1000]


def test_display():
    assert scalars.display(None) == "" and scalars.display("a€中") == "a€?"


def test_limits():
    assert articles.capped(None) == 75 and articles.capped(999) == 250 and articles.capped(9999, "tv") == 3000
    with pytest.raises(ValueError):
        articles.capped(0)


def test_empty_timeline(spark):
    p = spark.createDataFrame([], "series string, date timestamp_ntz, value bigint")
    s = timelines.volume_summary(p).first()
    assert (s["total"], s["average"], s["peak"], s["peak_date"], s["points"]) == (None, None, None, None, 0)
    assert timelines.tone_summary(p).first()["points"] == 0 and timelines.bars(timelines.last(p, 15)).count() == 0


def test_zero_bars_and_ties(spark):
    p = spark.sql("SELECT 's' AS series, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id AS int)) AS date, 0L AS value FROM range(3)")
    assert {r["bar"] for r in timelines.bars(p).collect()} == {0}
    assert str(timelines.volume_summary(p).first()["peak_date"]) == "2024-01-01 00:00:00"


def test_smoothing(spark):
    p = spark.createDataFrame([("s", k, float(k)) for k in range(4)], "series string, date int, value double")
    assert [r["value"] for r in timelines.smoothed(p, 2).orderBy("date").collect()] == [0.0, 0.5, 1.5, 2.5]
    assert timelines.smoothed(p, 1) is p
    with pytest.raises(ValueError):
        timelines.smoothed(p, 31)


def test_over_cap_boundary(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' AS t FROM range(250) UNION ALL SELECT timestamp_ntz'2024-01-02' FROM range(251)")
    assert {str(r["day"]): r["split"] for r in articles.over_cap(df, "t").collect()} == {"2024-01-01": False, "2024-01-02": True}
    assert sum(r["n"] for r in articles.split_windows(df, "t").collect()) == 501
