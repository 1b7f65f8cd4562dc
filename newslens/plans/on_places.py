"""Queries over places and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions import scalars, times
from newslens.operators import broadcasts, places
from newslens.sources import views

from .on_documents import NORM
from .query import matches

MENTIONS = """WITH m AS (SELECT c_custkey AS article_id, n_name AS country, r_name AS region, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS cc, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'A' || (c_custkey % 5) AS adm1,
CAST(c_custkey % 3 AS INTEGER) AS level, CAST(n_nationkey * 7 - 80 + c_custkey % 3 AS DOUBLE) AS lat, CAST(n_nationkey * 14 - 170 + c_custkey % 5 AS DOUBLE) AS lon, c_mktsegment AS theme,
TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 37 % 10080) AS seendate, CAST((c_custkey * 7) % 21 - 10 AS DOUBLE) AS tone
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CLIPS = f"""WITH k AS (SELECT conv_id AS broadcast, turn AS clip, role AS station, 'show' || (conv_id % 13) AS "show", 'net' || (conv_id % 3) AS network, CASE WHEN conv_id % 2 = 0 THEN 'National' ELSE 'Local' END AS market,
TIMESTAMP '2024-01-01' + to_hours(conv_id % 480) + to_seconds(turn * 15) AS date, {NORM} AS norm FROM conversations)"""
BUILDING = "theme = 'BUILDING'"
STAMP = "'%Y%m%dT%H%M%SZ'"


def geo(build, query: str = "theme:building"):
    return lambda spark, sf_dir: build(views.mentions(spark, sf_dir), matches(query, views.mentions_view()))


def tv(build, query: str = "the"):
    return lambda spark, sf_dir: build(views.clips(spark, sf_dir), matches(query, views.clips_view()))


def stamp(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, times.stamp(F.col(c)))
    return df


def ids(df: DataFrame, m) -> DataFrame:
    return df.where(m).select("article_id")


def geojson(df: DataFrame, m) -> DataFrame:
    """Places as GeoJSON, and read back."""
    p = places.points(df, m, most=50)
    back = places.from_feature(places.feature(F.col("adm1"), F.col("lat"), F.col("lon"), count=F.col("n")))
    return p.select("level", "n", back.alias("b")).select("level", "n", "b.name", "b.lat", "b.lon")


def density_sql(*keys: str) -> str:
    return f"{MENTIONS} SELECT {', '.join(keys)}, count(*) FILTER ({BUILDING}) AS matched, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER ({BUILDING}) / count(*), 6) AS density FROM m GROUP BY ALL"


POINTS = f"""{MENTIONS}, p AS (SELECT country, adm1, level, lat, lon, count(*) AS n, array_to_string(list_slice(list_sort(list(article_id)), 1, 5), ',') AS articles FROM m WHERE {BUILDING} GROUP BY ALL)"""
DISTANCE = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(20) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(30 - lon) / 2), 2))))"

QUERIES = {
    "geo_points": (geo(lambda df, m: places.points(df, m).withColumn("articles", F.array_join(F.col("articles").cast("array<string>"), ","))), f"{POINTS} SELECT * FROM p ORDER BY n DESC, adm1, level, lat, lon LIMIT 1000"),
    "geo_heatmap": (geo(places.heatmap), f"{MENTIONS} SELECT lat, lon, count(*) AS n FROM m WHERE {BUILDING} GROUP BY ALL ORDER BY n DESC, lat, lon LIMIT 25000"),
    "geo_anim": (geo(lambda df, m: stamp(places.animation(df, m), "date")), f"{MENTIONS} SELECT strftime(time_bucket(INTERVAL 15 MINUTES, seendate), {STAMP}) AS date, lat, lon, count(*) AS n FROM m WHERE {BUILDING} GROUP BY time_bucket(INTERVAL 15 MINUTES, seendate), lat, lon"),
    "geo_country_density": (geo(lambda df, m: places.density(df, m, "country")), density_sql("country")),
    "geo_adm1": (geo(lambda df, m: places.density(df, m, "adm1")), density_sql("adm1")),
    "geo_sourcecountry": (geo(lambda df, m: places.density(df, m, "region", "country")), density_sql("region", "country")),
    "geo_name": (geo(ids, 'location:"nation_7"'), f"{MENTIONS} SELECT article_id FROM m WHERE country = 'NATION_7'"),
    "geo_cc": (geo(ids, "locationcc:nation_7 -tone<0"), f"{MENTIONS} SELECT article_id FROM m WHERE cc = 'N07' AND NOT tone < 0"),
    "geo_adm1_filter": (geo(ids, "(locationadm1:N07A1 OR locationadm1:N08A2)"), f"{MENTIONS} SELECT article_id FROM m WHERE adm1 IN ('N07A1', 'N08A2')"),
    "geo_radius": (geo(lambda df, m: df.where(m).select("article_id", F.round(scalars.distance_km(F.col("lat"), F.col("lon"), 20, 30), 3).alias("km")), "near:20,30,2000km"), f"{MENTIONS} SELECT article_id, round({DISTANCE}, 3) AS km FROM m WHERE {DISTANCE} <= 2000"),
    "geo_res": (geo(lambda df, m: places.at_resolution(df, 2).where(m).select("article_id", "level")), f"{MENTIONS} SELECT article_id, level FROM m WHERE level >= 2 AND {BUILDING}"),
    "geojson": (geo(geojson), f"{POINTS} SELECT level, n, adm1 AS name, lat, lon FROM p ORDER BY n DESC, adm1, level, lat, lon LIMIT 50"),
    "tv_context_adjacent": (
        tv(lambda df, m: broadcasts.in_context(df, m).select("broadcast", "clip"), '"of the"'),
        f"{CLIPS}, h AS (SELECT broadcast, clip, contains(norm, ' of the ') AS p FROM k) SELECT DISTINCT h.broadcast, h.clip FROM h JOIN h g ON h.broadcast = g.broadcast AND abs(h.clip - g.clip) <= 1 WHERE g.p",
    ),
    "tv_filter": (tv(lambda df, m: df.where(m).select("broadcast", "clip", "show"), 'market:"National" station:user (network:net1 OR show:"show4") -was'), f'''{CLIPS} SELECT broadcast, clip, "show" FROM k WHERE market = 'National' AND station = 'user' AND (network = 'net1' OR "show" = 'show4') AND NOT contains(norm, ' was ')'''),
    "tv_timeline": (tv(lambda df, m: stamp(broadcasts.timeline(df, m, "day"), "date")), f"{CLIPS} SELECT station AS series, strftime(date_trunc('day', date), {STAMP}) AS date, round(100.0::DOUBLE * count(*) FILTER (contains(norm, ' the ')) / count(*), 6) AS value FROM k GROUP BY station, date_trunc('day', k.date)"),
    "tv_timeline_raw": (tv(lambda df, m: stamp(broadcasts.timeline(df, m, "week", raw=True, combined=True), "date")), f"{CLIPS} SELECT 'Combined' AS series, strftime(date_trunc('week', date), {STAMP}) AS date, CAST(count(*) FILTER (contains(norm, ' the ')) AS DOUBLE) AS value FROM k GROUP BY date_trunc('week', k.date)"),
    "tv_airtime": (tv(lambda df, m: stamp(broadcasts.airtime(df, "month"), "date")), f"{CLIPS} SELECT station AS series, strftime(date_trunc('month', date), {STAMP}) AS date, count(*) * 15 AS value FROM k GROUP BY station, date_trunc('month', k.date)"),
    "tv_shows": (tv(broadcasts.shows), f'''{CLIPS} SELECT "show", count(*) AS n FROM k WHERE contains(norm, ' the ') GROUP BY "show" ORDER BY n DESC, "show" LIMIT 10'''),
    "tv_stations": (tv(broadcasts.stations), f"{CLIPS} SELECT station, count(*) FILTER (contains(norm, ' the ')) AS n, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (contains(norm, ' the ')) / count(*), 6) AS percent FROM k GROUP BY station"),
    "tv_details": (tv(lambda df, m: stamp(broadcasts.details(df), "first", "last")), f"{CLIPS} SELECT station, network, market, strftime(min(date), {STAMP}) AS first, strftime(max(date), {STAMP}) AS last FROM k GROUP BY ALL"),
    "tv_wordcloud": (tv(broadcasts.word_cloud), f"{CLIPS}, w AS (SELECT unnest(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS word FROM k WHERE contains(norm, ' the ')) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 200"),
    "tv_clips": (tv(lambda df, m: stamp(df.where(m).orderBy(F.desc("date"), "broadcast", "clip").limit(50).select("show", "station", "date", "broadcast", "clip"), "date")), f'''{CLIPS} SELECT "show", station, strftime(date, {STAMP}) AS date, broadcast, clip FROM k WHERE contains(norm, ' the ') ORDER BY k.date DESC, broadcast, clip LIMIT 50'''),
    "tv_trending": (
        tv(lambda df, m: broadcasts.trending(df, "2024-01-04 00:00:00")),
        f"{CLIPS}, w AS (SELECT date >= TIMESTAMP '2024-01-04' AS r, unnest(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS word FROM k), c AS (SELECT word, count(*) FILTER (r) AS recent, count(*) FILTER (NOT r) AS before FROM w GROUP BY word) SELECT word, recent, before, round((recent + 1) / (before + 1)::DOUBLE, 6) AS ratio FROM c WHERE recent >= 5 ORDER BY ratio DESC, word LIMIT 25",
    ),
}
