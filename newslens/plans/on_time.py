"""Queries over coverage in time: windows, timelines, sorts, and what is read off timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions import times
from newslens.operators import articles, timelines
from newslens.sources import views
from newslens.streaming import live

from .query import matches
from .run import QuerySpec, run

NOW = "2024-01-31 00:00:00"
#: Coverage as SQL sees it.
COVERAGE = """WITH c AS (SELECT event_id, ts AS seendate, event_type AS series, value - 50 AS tone, ['English', 'French', 'German', 'Spanish'][user_id % 4 + 1] AS language,
'user' || user_id || '.example.com' AS domain FROM events)"""
STAMP = "'%Y%m%dT%H%M%SZ'"


def over(build: Callable[[DataFrame, Column], DataFrame], query: str = "theme:click"):
    """A query that builds on coverage and a condition; dates come out as the services write them."""

    def run_(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(views.coverage(spark, sf_dir), matches(query, views.coverage_view()))
        return stamped(out)

    return run_


def stamped(out: DataFrame) -> DataFrame:
    for c, kind in out.dtypes:
        if kind == "timestamp_ntz":
            out = out.withColumn(c, times.stamp(F.col(c)))
    return out


def spec(query: str, **more: object):
    def run_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stamped(run(views.coverage(spark, sf_dir), views.coverage_view(), QuerySpec(query, **more)))

    return run_


def bucket_sql(width: str, ts: str = "seendate") -> str:
    return f"time_bucket(INTERVAL 15 MINUTES, {ts})" if width == "15min" else f"date_trunc('{width}', {ts})"


def raw_sql(width: str, where: str = "TRUE", match: str = "series = 'click'") -> str:
    return f"{COVERAGE} SELECT 'Article Count' AS series, strftime({bucket_sql(width)}, {STAMP}) AS date, count(*) FILTER ({match}) AS value, count(*) AS norm FROM c WHERE {where} GROUP BY {bucket_sql(width)}"


PERCENT = "round(100.0::DOUBLE * count(*) FILTER (series = 'click') / count(*), 6)"
DAILY_RAW = f"{COVERAGE}, p AS (SELECT 'Article Count' AS series, date_trunc('day', seendate) AS date, count(*) FILTER (series = 'click') AS value, count(*) AS norm FROM c GROUP BY 2)"
TONE = f"{COVERAGE}, p AS (SELECT date_trunc('day', seendate) AS date, round(avg(tone), 6) AS value FROM c WHERE series = 'click' GROUP BY 1)"
SUMMARY = "SELECT round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(value) AS points, CASE WHEN avg(value) > 2 THEN 'POSITIVE' WHEN avg(value) > 0 THEN 'SLIGHTLY POSITIVE' WHEN avg(value) > -2 THEN 'SLIGHTLY NEGATIVE' ELSE 'NEGATIVE' END AS label"
VOLUME_SUMMARY = f"SELECT CAST(sum(value) AS BIGINT) AS total, round(sum(value)::DOUBLE / {{by}}, 6) AS average, CAST(max(value) AS BIGINT) AS peak, strftime(arg_min(date, {{{{'v': -value, 'd': date}}}}), {STAMP}) AS peak_date, count(value) AS points"


def volume_sql(by: str, source: str) -> str:
    return VOLUME_SUMMARY.format(by=by).replace("{{", "{").replace("}}", "}") + f" FROM {source}"


def by_series(series: str):
    return lambda df, m: timelines.by_series(df, m, "seendate", "day", series)


def series_sql(series: str) -> str:
    return f"""{COVERAGE}, g AS (SELECT {series} AS series, date_trunc('day', seendate) AS date, count(*) FILTER (series = 'click') AS n, count(*) AS a FROM c GROUP BY 1, 2),
t AS (SELECT *, sum(a) OVER (PARTITION BY date) AS norm FROM g), p AS (SELECT series, date, round(100.0::DOUBLE * n / norm, 6) AS value FROM t WHERE n > 0)"""


def day_raw(df: DataFrame, m: Column) -> DataFrame:
    return timelines.volume_raw(df, m, "seendate", "day")


def sorted_by(sort: str):
    """Sorted by what is shown, as in the SQL, where these names are the output's: stamps of whole seconds, and rounded tones."""
    return lambda df, m: articles.top(stamped(df.where(m).select("event_id", "seendate", F.round("tone", 6).alias("tone"))), sort, 25, "event_id")


def sorted_sql(order: str) -> str:
    return f"{COVERAGE} SELECT event_id, strftime(seendate, {STAMP}) AS seendate, round(tone, 6) AS tone FROM c WHERE series = 'click' ORDER BY {order} NULLS LAST, event_id LIMIT 25"


def union_windows(df: DataFrame, m: Column) -> DataFrame:
    """Two overlapping windows, joined into one list without repeats."""
    part = lambda a, b: df.where(m & times.TimeWindow.absolute(a, b).holds(F.col("seendate")))
    rows = part("20240101000000", "20240112235959").unionByName(part("20240110000000", "20240120235959"))
    return articles.dedupe(rows, "event_id", F.col("seendate")).select("event_id", "seendate")


def response(df: DataFrame, m: Column) -> DataFrame:
    """A timeline as a service nests it, read back into points; one point is made unreadable."""
    points = stamped(day_raw(df, m))
    bad = F.when(F.col("date") == "20240102T000000Z", "n/a").otherwise(F.col("value").cast("string"))
    nested = points.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("date", bad.alias("value")))).alias("data")).agg(F.collect_list(F.struct("series", "data")).alias("timeline"))
    return timelines.flatten(nested)


def stream(kind: str):
    """The feed replayed as a stream to its end; the table's folder is the source."""

    def run_(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        # a stream reads folders
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        feed = source.select("event_id", F.col("ts").cast("timestamp_ntz").alias("seendate"), F.col("event_type").alias("series"))
        out = live.timeline(feed, F.col("series") == "click", "seendate", "1 day")
        name = f"live_{uuid.uuid4().hex}"
        out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).select(F.date_format("date", times.STAMP_SPARK).alias("date"), "value", "norm")

    return run_


def _count(df: DataFrame, m: Column) -> DataFrame:
    p = day_raw(df, m)
    return p.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("value") != 0).alias("nonzero"))


QUERIES = {
    "timespan_rel": (over(lambda df, m: df.where(times.relative(F.col("seendate"), "7d", NOW)).select("event_id", "seendate")), f"{COVERAGE} SELECT event_id, strftime(seendate, {STAMP}) AS seendate FROM c WHERE seendate BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'"),
    "abs_range": (over(lambda df, m: df.where(times.TimeWindow.absolute("20240105000000", "20240106235959").holds(F.col("seendate"))).select("event_id", "series")), f"{COVERAGE} SELECT event_id, series FROM c WHERE seendate BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 23:59:59'"),
    "tone_lt": (over(lambda df, m: df.where(m).select("event_id"), "tone<-20"), f"{COVERAGE} SELECT event_id FROM c WHERE tone < -20"),
    "tone_abs": (over(lambda df, m: df.where(m).select("event_id"), "toneabs>45 sourcelang:french"), f"{COVERAGE} SELECT event_id FROM c WHERE abs(tone) > 45 AND language = 'French'"),
    "domain_group": (over(lambda df, m: df.where(m).select("event_id", "domain"), "(domain:user3.example.com OR domainis:user7.example.com) -theme:view"), f"{COVERAGE} SELECT event_id, domain FROM c WHERE domain IN ('user3.example.com', 'user7.example.com') AND series <> 'view'"),
    "timeline_volraw": (spec("theme:click", mode="timelinevolraw"), raw_sql("day")),
    "timeline_vol": (spec("theme:click", mode="timelinevol"), f"{COVERAGE} SELECT 'Volume Intensity' AS series, strftime(date_trunc('day', seendate), {STAMP}) AS date, {PERCENT} AS value FROM c GROUP BY date_trunc('day', seendate)"),
    "timeline_tone": (spec("theme:click", mode="timelinetone"), f"{TONE} SELECT 'Average Tone' AS series, strftime(date, {STAMP}) AS date, value FROM p"),
    "timeline_lang": (spec("theme:click", mode="timelinelang"), f"{series_sql('language')} SELECT series, strftime(date, {STAMP}) AS date, value FROM p"),
    "timeline_series": (over(by_series("domain")), f"{series_sql('domain')} SELECT series, strftime(date, {STAMP}) AS date, value FROM p"),
    "timeline_volinfo": (
        over(lambda df, m: timelines.with_articles(df, m, "seendate", "day", [F.desc("seendate"), F.col("event_id")], F.col("event_id")).select("date", "value", F.array_join(F.col("articles").cast("array<string>"), ",").alias("articles"))),
        f"""{COVERAGE}, r AS (SELECT date_trunc('day', seendate) AS d, event_id, row_number() OVER (PARTITION BY date_trunc('day', seendate) ORDER BY seendate DESC, event_id) AS n FROM c WHERE series = 'click'),
l AS (SELECT d, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS articles FROM r WHERE n <= 10 GROUP BY d), v AS (SELECT date_trunc('day', seendate) AS d, {PERCENT} AS value FROM c GROUP BY 1)
SELECT strftime(d, {STAMP}) AS date, value, articles FROM v LEFT JOIN l USING (d)""",
    ),
    "timeline_smooth": (spec("theme:click", mode="timelinetone", smoothing=5), f"{TONE} SELECT 'Average Tone' AS series, strftime(date, {STAMP}) AS date, round(avg(value) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM p"),
    "timeline_gapfill": (
        over(lambda df, m: timelines.filled(timelines.volume_raw(df.where(times.relative(F.col("seendate"), "2d", NOW)), m, "seendate", "15min").drop("series"), "2024-01-29 00:00:00", "2024-01-31 00:00:00", "INTERVAL 15 MINUTES", value=0, norm=0)),
        f"{COVERAGE}, p AS (SELECT time_bucket(INTERVAL 15 MINUTES, seendate) AS d, count(*) FILTER (series = 'click') AS value, count(*) AS norm FROM c WHERE seendate BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-31' GROUP BY 1), g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTES)) AS d) SELECT strftime(g.d, {STAMP}) AS date, coalesce(value, 0) AS value, coalesce(norm, 0) AS norm FROM g LEFT JOIN p ON g.d = p.d",
    ),
    "res_15min": (spec("theme:click", mode="timelinevolraw", timespan="24h", now=NOW), raw_sql("15min", "seendate BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31'")),
    "res_hour": (spec("theme:click", mode="timelinevolraw", timespan="1w", now=NOW), raw_sql("hour", "seendate BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'")),
    "res_day": (spec("theme:click", mode="timelinevolraw", start="20240101000000", end="20240120235959"), raw_sql("day", "seendate BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20 23:59:59'")),
    "tone_chart": (spec("theme:click", mode="tonechart"), f"{COVERAGE} SELECT CAST(floor(tone) AS BIGINT) AS bin, count(*) AS n FROM c WHERE series = 'click' GROUP BY 1"),
    "sort_date_desc": (over(sorted_by("datedesc")), sorted_sql("seendate DESC")),
    "sort_date_asc": (over(sorted_by("dateasc")), sorted_sql("seendate")),
    "sort_tone_desc": (over(sorted_by("tonedesc")), sorted_sql("tone DESC")),
    "sort_tone_asc": (over(sorted_by("toneasc")), sorted_sql("tone")),
    "top_domains": (over(lambda df, m: timelines.most_common(df, "domain", 20, "event_id")), f"{COVERAGE} SELECT domain AS key, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 20"),
    "series_totals": (over(lambda df, m: timelines.series_totals(timelines.by_series(df, m, "seendate", "day", "language"), 15)), f"{series_sql('language')} SELECT series, round(sum(value), 6) AS total FROM p GROUP BY series ORDER BY total DESC, series LIMIT 15"),
    "peak_first_tie": (over(lambda df, m: day_raw(df, m).agg(timelines.peak("date", "value").alias("date"), F.max("value").alias("value"))), f"{DAILY_RAW} SELECT strftime(date, {STAMP}) AS date, value FROM p ORDER BY value DESC, p.date LIMIT 1"),
    "tone_summary": (over(lambda df, m: timelines.tone_summary(timelines.tone(df, m, "seendate", "day"))), f"{TONE} {SUMMARY} FROM p"),
    "tone_summary_nz": (over(lambda df, m: timelines.tone_summary(timelines.tone(df, m, "seendate", "day"), zeros=False)), f"{TONE} {SUMMARY} FROM p WHERE value <> 0"),
    "volume_summary": (over(lambda df, m: timelines.volume_summary(day_raw(df, m))), f"{DAILY_RAW} {volume_sql('count(value)', 'p')}"),
    "volume_fixed_days": (over(lambda df, m: timelines.volume_summary(day_raw(df, m), periods=90)), f"{DAILY_RAW} {volume_sql('90', 'p')}"),
    "volume_last15": (over(lambda df, m: timelines.volume_summary(timelines.last(day_raw(df, m), 15))), f"{DAILY_RAW} {volume_sql('count(value)', '(SELECT * FROM p ORDER BY p.date DESC LIMIT 15)')}"),
    "bars": (over(lambda df, m: timelines.bars(timelines.last(day_raw(df, m), 15)).select("date", "value", "bar", "place")), f"{DAILY_RAW}, l AS (SELECT * FROM p ORDER BY p.date DESC LIMIT 15) SELECT strftime(date, {STAMP}) AS date, value, CAST(floor(value / max(value) OVER () * 40) AS BIGINT) AS bar, CAST(row_number() OVER (ORDER BY l.date) AS INTEGER) AS place FROM l"),
    "daily_rebucket": (over(lambda df, m: timelines.daily(timelines.volume_raw(df, m, "seendate", "hour")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "value")), f"{COVERAGE} SELECT strftime(seendate, '%Y-%m-%d') AS day, count(*) FILTER (series = 'click') AS value FROM c GROUP BY 1"),
    "point_counts": (over(_count), f"{DAILY_RAW} SELECT count(*) AS points, count(*) FILTER (value <> 0) AS nonzero FROM p"),
    "window_plan": (over(lambda df, m: articles.over_cap(df, "seendate").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "split")), f"{COVERAGE} SELECT strftime(seendate, '%Y-%m-%d') AS day, count(*) AS n, count(*) > 250 AS split FROM c GROUP BY 1"),
    "window_split": (
        over(lambda df, m: articles.split_windows(df, "seendate", 40).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "from_minute", "minutes", "n")),
        f"""{COVERAGE}, m AS (SELECT CAST(seendate AS DATE) AS day, CAST(date_diff('second', date_trunc('day', seendate), seendate) // 60 AS INTEGER) AS m FROM c),
w AS (SELECT * FROM (VALUES (0, 1440), (1, 720), (2, 360), (3, 180), (4, 90), (5, 45), (6, 15)) v(k, w)),
l AS (SELECT day, k, w, m // w AS part, count(*) AS n FROM m, w GROUP BY 1, 2, 3, 4)
SELECT strftime(l.day, '%Y-%m-%d') AS day, CAST(l.part * l.w AS INTEGER) AS from_minute, CAST(l.w AS INTEGER) AS minutes, l.n FROM l
LEFT JOIN l u ON u.day = l.day AND u.k = l.k - 1 AND u.part = l.part * l.w // u.w WHERE (l.n <= 40 OR l.k = 6) AND (l.k = 0 OR u.n > 40)""",
    ),
    "union_windows": (over(union_windows), f"{COVERAGE} SELECT event_id, strftime(seendate, {STAMP}) AS seendate FROM c WHERE series = 'click' AND seendate BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20 23:59:59'"),
    "flatten_response": (over(response), f"{DAILY_RAW} SELECT series, strftime(date, {STAMP}) AS date, CAST(value AS DOUBLE) AS value FROM p WHERE date <> TIMESTAMP '2024-01-02'"),
    "live_timeline": (stream("timeline"), f"{COVERAGE} SELECT strftime(date_trunc('day', seendate), {STAMP}) AS date, count(*) FILTER (series = 'click') AS value, count(*) AS norm FROM c GROUP BY date_trunc('day', seendate)"),
    "volume_spikes": (
        over(lambda df, m: live.spikes(timelines.volume_raw(df, m, "seendate", "hour"), 24, 2.0).select("date", "value", "z")),
        f"""{COVERAGE}, p AS (SELECT date_trunc('hour', seendate) AS date, count(*) FILTER (series = 'click') AS value FROM c GROUP BY 1),
z AS (SELECT date, value, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT strftime(date, {STAMP}) AS date, value, z FROM z WHERE z > 2""",
    ),
}
