"""Formats, streams, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from newslens import cli
from newslens.operators import places
from newslens.sources import sinks, views
from newslens.streaming import live


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [
        ("http://a.com/1", "Recall of the device", "20240110T120000Z", "a.com", "English", "France", -3.0),
        ("http://b.com/2", 'Warning, "quoted"', "20240109T120000Z", "b.com", "English", "United States", 1.0),
        ("http://c.com/3", "Recall elsewhere", "bad", "c.com", "English", None, None),
        ("http://d.com/4", "Rappel", "20240110T110000Z", "d.com", "French", "France", 2.0),
    ]
    path = str(tmp_path_factory.mktemp("t") / "articles.parquet")
    spark.createDataFrame(rows, "url string, title string, seendate string, domain string, language string, sourcecountry string, tone double").write.parquet(path)
    return path


def test_articles(spark, table, capsys):
    assert cli.main(["recall or warning", "--table", table], spark) == 0
    out, err = capsys.readouterr()
    assert "Searching for: (recall OR warning)" in err
    assert "a.com" in out and "b.com" in out and "d.com" not in out and "c.com" not in out


def test_json_wins(spark, table, capsys, tmp_path):
    assert cli.main(["recall", "--table", table, "--json", "--csv", str(tmp_path / "x.csv"), "--sort", "date"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["count"] == 1 and found["articles"][0]["seendate"] == "20240110T120000Z" and found["query"] == "recall sourcelang:english"
    assert not (tmp_path / "x.csv").exists()


def test_csv(spark, table, capsys, tmp_path):
    assert cli.main(["warning", "--table", table, "--csv", str(tmp_path / "x.csv")], spark) == 0
    lines = (tmp_path / "x.csv").read_text().splitlines()
    assert lines == ["Date,Title,Source,SourceCountry,Language,URL", '2024-01-09 12:00,"Warning, ""quoted""",b.com,United States,English,http://b.com/2']
    assert cli.main(["nothing", "--table", table, "--csv", str(tmp_path / "y.csv")], spark) == 0
    assert not (tmp_path / "y.csv").exists()
    assert cli.main(["recall", "--table", table, "--mode", "tone", "--csv", str(tmp_path / "z.csv")], spark) == 0
    assert "ignored" in capsys.readouterr().err and not (tmp_path / "z.csv").exists()


def test_modes(spark, table, capsys):
    assert cli.main(["(recall OR warning)", "--table", table, "--mode", "timeline"], spark) == 0
    assert "Total 2" in capsys.readouterr().out
    assert cli.main(["(recall OR warning)", "--table", table, "--mode", "tone"], spark) == 0
    assert "Average -1.00 (SLIGHTLY NEGATIVE)" in capsys.readouterr().out


def test_bad_query(spark, table):
    assert cli.main(["(a or (b or c))", "--table", table], spark) == 1
    assert cli.main(["a", "--table", table, "--timespan", "soon"], spark) == 1


def test_texts(spark):
    df = spark.createDataFrame([("http://x", "A & B")], "url string, title string").withColumn("seendate", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    assert sinks.csv_text(sinks.csv_row(df.withColumns({c: F.lit(None).cast("string") for c in ("domain", "sourcecountry", "language")})), bom=True) == "﻿Date,Title,Source,SourceCountry,Language,URL\r\n2024-01-01 00:00,A & B,,,,http://x\r\n"
    feed = json.loads(sinks.json_feed([r[0] for r in df.select(sinks.feed_item(df)).collect()], "t"))
    assert feed["items"][0] == {"id": "http://x", "url": "http://x", "title": "A & B", "date_published": "2024-01-01T00:00:00Z"}
    assert "<title>A &amp; B</title>" in sinks.rss([{"url": "http://x", "title": "A & B", "url_mobile": "m"}], "t", archive=True)
    assert "<mobileurl>m" in sinks.rss([{"url": "http://x", "url_mobile": "m"}], "t", archive=True)
    assert sinks.preview('{"a": [1, 2, 3]}', 2).endswith("...")
    with pytest.raises(ValueError):
        sinks.jsonp(F.lit("{}"), "alert(1);x")


def test_geojson(spark):
    df = spark.createDataFrame([("p", 1.5, 0.0)], "name string, lat double, lon double")
    f = df.select(places.feature(F.col("name"), F.col("lat"), F.col("lon")).alias("f"))
    assert json.loads(sinks.feature_collection([f.first()[0]]))["features"][0]["geometry"]["coordinates"] == [0.0, 1.5]
    assert tuple(f.select(places.from_feature(F.col("f"))).first()[0]) == ("p", 1.5, 0.0)


def test_stream_closed_windows(spark, tmp_path):
    """Windows that have closed are the same as in batch, and none is emitted twice."""
    base = views.coverage(spark, "/root/testdata/sf0.001").select("event_id", "seendate", "series")
    base.orderBy("seendate").repartitionByRange(5, "seendate").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.drain(live.timeline(feed, F.col("series") == "click", "seendate"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["date"]: (r["value"], r["norm"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["date"]: (r["value"], r["norm"]) for r in base.groupBy(F.window(F.col("seendate").cast("timestamp"), "15 minutes").alias("w")).agg(F.count_if(F.col("series") == "click").alias("value"), F.count(F.lit(1)).alias("norm")).select("w.start", "value", "norm").withColumnRenamed("start", "date").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    live.drain(live.timeline(feed, F.col("series") == "click", "seendate"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= len(got)


def test_stream_distinct(spark, tmp_path):
    spark.sql("SELECT concat('u', id % 7) AS url, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS seendate FROM range(50)").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("url string, seendate timestamp_ntz").parquet(str(tmp_path / "in"))
    live.drain(live.distinct(feed, "url", "seendate"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"u{k}" for k in range(7)]


def test_json_of_timelines_is_nested(spark, table, capsys):
    assert cli.main(["(recall OR warning)", "--table", table, "--mode", "timeline", "--json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["timeline"][0]["series"] == "Article Count" and sum(d["value"] for d in found["timeline"][0]["data"]) == 2 and "query_details" in found
