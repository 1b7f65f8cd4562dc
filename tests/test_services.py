"""One entry for all services, nested responses, and partitioned tables."""

import json

import pytest
from pyspark.sql import functions as F

from newslens.operators import timelines
from newslens.plans import registry
from newslens.plans.on_time import stamped
from newslens.plans.query import View
from newslens.plans.run import QuerySpec, dispatch
from newslens.sources import tables, views

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize(
    "service, mode, query, same",
    [
        ("doc", "timelinevol", "theme:click", "timeline_vol"), ("geo", "country", "theme:building", "geo_country_density"), ("geo", "pointheatmap", "theme:building", "geo_heatmap"), ("geo", "imageadm1", "theme:building", "geo_adm1"),
        ("tv", "timelinevol", "the", "tv_timeline"), ("tv", "showchart", "the", "tv_shows"), ("tv", "stationchart", "the", "tv_stations"), ("tv", "wordcloud", "the", "tv_wordcloud"), ("tv", "stationdetails", "the", "tv_details"),
    ],
)
def test_dispatch(spark, service, mode, query, same):
    table, view = {"doc": (views.coverage, views.coverage_view), "geo": (views.mentions, views.mentions_view), "tv": (views.clips, views.clips_view)}[service]
    out = dispatch(table(spark, DATA), view(), QuerySpec(query, mode=mode, service=service))
    assert rows(stamped(out)) == rows(registry.queries()[same](spark, DATA))


def test_context(spark):
    df = spark.createDataFrame([(1, 'He said "of course" to the man. The end of it.'), (2, "Of the of the of the. No."), (3, None)], "doc_id int, text string")
    view = View(F.col("norm"))
    # both words once: the shorter sentence goes first
    assert [(r["doc_id"], r["sent_idx"]) for r in dispatch(df, view, QuerySpec("of the", service="context")).collect()] == [(2, 0), (1, 1), (1, 0)]
    assert [r["doc_id"] for r in dispatch(df, view, QuerySpec("of the", service="context", isquote=True)).collect()] == [1]
    with pytest.raises(ValueError):
        dispatch(df, view, QuerySpec("of", service="context", sort="toneasc"))


def test_errors(spark):
    df = views.coverage(spark, DATA)
    for bad in ({"service": "x"}, {"mode": "x"}, {"service": "geo", "mode": "x"}, {"service": "tv", "mode": "x"}):
        with pytest.raises(ValueError):
            dispatch(views.mentions(spark, DATA) if bad.get("service") == "geo" else df, views.mentions_view() if bad.get("service") == "geo" else views.coverage_view(), QuerySpec("theme:click", **bad))
    with pytest.raises(ValueError):
        QuerySpec("a", timespan="1d", now="2024-01-01", start="20240101000000")
    with pytest.raises(ValueError):
        QuerySpec("a", timespan="1d")


def test_nested_response(spark):
    df = views.coverage(spark, DATA)
    points = timelines.volume_raw(df, F.col("series") == "click", "seendate", "day")
    response = timelines.nested(points, "clicks", "day")
    found = json.loads(response.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    assert found["query_details"] == {"title": "clicks", "date_resolution": "day"}
    data = found["timeline"][0]["data"]
    assert [d["date"] for d in data] == sorted(d["date"] for d in data) and set(data[0]) == {"date", "value", "norm"}
    assert rows(timelines.flatten(response)) == rows(stamped(points).select("series", "date", F.col("value").cast("double").alias("value")))


def test_partitions_are_pruned(spark, tmp_path):
    events = views.warehouse(spark, DATA).select("EventId", "partition_date")
    tables.write_by_day(events, str(tmp_path / "e"), "partition_date")
    part = tables.between_days(spark, str(tmp_path / "e"), "partition_date", "1996-01-01", "1996-02-01")
    want = events.where("partition_date >= DATE '1996-01-01' AND partition_date < DATE '1996-02-01'")
    assert part.count() == want.count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan


def test_filters_reach_the_scan(spark):
    """Comparisons are pushed down, and only the columns in use are read."""
    from newslens.plans.query import matches, number

    events = spark.read.parquet(f"{DATA}/events.parquet")
    found = events.where(matches("tone>400 -tone>450", View(None, {"tone": number(F.col("value"))}))).select("event_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,400.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_time_windows_of_all_services(spark):
    """A window narrows every service, and one bound alone counts."""
    day = {"start": "20240103000000", "end": "20240103235959"}
    geo = lambda **more: dispatch(views.mentions(spark, DATA), views.mentions_view(), QuerySpec("theme:building", "pointheatmap", service="geo", **more)).agg(F.sum("n")).first()[0] or 0
    tv = lambda **more: dispatch(views.clips(spark, DATA), views.clips_view(), QuerySpec("the", "showchart", service="tv", **more)).agg(F.sum("n")).first()[0] or 0
    doc = lambda **more: dispatch(views.coverage(spark, DATA), views.coverage_view(), QuerySpec("theme:click", "timelinevolraw", **more)).agg(F.sum("value")).first()[0] or 0
    text = lambda **more: dispatch(views.articles(spark, DATA), views.articles_view(), QuerySpec("the", service="context", maxrecords=200, **more)).count()
    for found in (geo, tv, doc, text):
        assert 0 <= found(**day) < found() and found(start="20300101000000") == 0
        assert found(start=day["start"]) >= found(**day) <= found(end=day["end"])
    assert doc(start="20240120000000") + doc(end="20240119235959") == doc()
    with pytest.raises(ValueError):
        dispatch(spark.createDataFrame([(1, "a")], "doc_id int, text string"), View(F.col("norm")), QuerySpec("a", service="context", start="20240101000000"))


def test_default_sort(spark):
    """Relevance and the outlet's volume; rows without an outlet stay, with no volume."""
    rows = [(1, "a.com", " x "), (2, None, " x "), (3, "b.com", " x x x "), (4, "a.com", " y "), (5, "a.com", " y ")]
    df = spark.createDataFrame(rows, "event_id int, domain string, norm string")
    found = dispatch(df, View(F.col("norm")), QuerySpec("x")).collect()
    assert [r["event_id"] for r in found] == [3, 1, 2] and found[1]["score"] > found[2]["score"]
    assert dispatch(views.coverage(spark, DATA), views.coverage_view(), QuerySpec("theme:click")).count() == 75


def test_sorts_of_places(spark):
    df, view = views.mentions(spark, DATA), views.mentions_view()
    spec = lambda sort: QuerySpec("theme:building", "pointdata", service="geo", sort=sort)
    with pytest.raises(ValueError):
        dispatch(df, view, spec("bogus"))
    tone = {r["article_id"]: r["tone"] for r in df.collect()}
    for sort, sign in (("tonedesc", -1), ("toneasc", 1)):
        for r in dispatch(df, view, spec(sort)).collect():
            assert r["articles"] == sorted(r["articles"], key=lambda a: (sign * tone[a], a))


@pytest.mark.parametrize("mode", ["timelinevolraw", "timelinevolinfo"])
def test_smoothing_of_volumes(spark, mode):
    df, view = views.coverage(spark, DATA), views.coverage_view()
    plain, smooth = (dispatch(df, view, QuerySpec("theme:click", mode, smoothing=n)).orderBy("date").collect() for n in (0, 5))
    want = [round(sum(r["value"] for r in plain[max(0, k - 4) : k + 1]) / min(5, k + 1), 6) for k in range(len(plain))]
    assert [r["value"] for r in smooth] == pytest.approx(want, abs=2e-6)


def test_prepared_copies(spark, tmp_path):
    """The same rows, from stored text and with conditions on folded fields asked of the scan."""
    from newslens.plans.query import matches
    from newslens.sources import prepared

    names = ["kw_and", "near_n", "near_postings", "lang_filter", "example_near", "tv_market", "geo_adm1", "timeline_lang", "domain_exact"]
    names = [n for n in names if n in registry.queries()]
    before = {n: rows(registry.queries()[n](spark, DATA)) for n in names}
    prepared.prepare(spark, DATA, str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        assert {n: rows(registry.queries()[n](spark, DATA)) for n in names} == before
        checks = [
            (views.documents, views.documents_view, "of that sourcelang:EN domainis:src1", ("EqualTo(lang_key,en)", "EqualTo(source_key,src1)")),
            (views.articles, views.articles_view, "sourcelang:english sourcecountry:france domainis:A.com", ("EqualTo(language_key,english)", "EqualTo(sourcecountry_key,france)", "EqualTo(domain_key,a.com)")),
            (views.coverage, views.coverage_view, "theme:click", ("EqualTo(series_key,click)",)),
            (views.mentions, views.mentions_view, "theme:building locationadm1:n01a1 location:x", ("EqualTo(theme_key,building)", "EqualTo(adm1_key,n01a1)", "EqualTo(location_key,x)")),
            (views.clips, views.clips_view, "station:user market:national", ("EqualTo(station_key,user)", "EqualTo(market_key,national)")),
        ]
        for table, view, query, pushed in checks:
            plan = table(spark, DATA).where(matches(query, view()))._jdf.queryExecution().executedPlan().toString()
            assert "regexp_replace" not in plan and all(p in plan for p in pushed), plan
    finally:
        prepared.forget(spark, DATA)
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "regexp_replace" in views.documents(spark, DATA).where(matches("of", views.documents_view()))._jdf.queryExecution().executedPlan().toString()


def test_entry_without_the_subpackage(tmp_path):
    """What the operators of the subpackage need may be missing; the other queries stay."""
    import os
    import subprocess
    import sys

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}:{here}"}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], env=env, capture_output=True, text=True, cwd=here)
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-2]) == len(registry.queries()), out.stderr
