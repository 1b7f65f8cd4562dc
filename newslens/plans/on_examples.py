"""The services' example searches, each through the one entry, and small keys for formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions import scalars
from newslens.operators import articles
from newslens.sources import sinks, views

from . import rewrite
from .on_documents import ARTICLES, NORM, as_articles
from .on_places import CLIPS, MENTIONS
from .on_time import COVERAGE, NOW, stamped
from .run import QuerySpec, dispatch

STAMP = "'%Y%m%dT%H%M%SZ'"
ROWS = f"""WITH a AS (SELECT doc_id, text, {NORM} AS norm, 'http://example.com/' || doc_id AS url, left(text, 60) AS title,
TIMESTAMP '2024-01-31' - to_minutes(doc_id * 37 % 129600) AS seendate,
CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS language,
source || '.example.com' AS domain, CASE doc_id % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'United States' END AS sourcecountry,
(doc_id * 13 % 41 - 20) / 2.0::DOUBLE AS tone FROM documents)"""
OF_THE = "contains(norm, ' of the ')"
THAT = "contains(norm, ' that ')"
ENGLISH = "language = 'English'"


def since(interval: str) -> str:
    return f"seendate BETWEEN TIMESTAMP '2024-01-31' - INTERVAL {interval} AND TIMESTAMP '2024-01-31'"


def show(query: str, *columns: str, **more: object):
    """A search over articles, by its columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = dispatch(views.articles(spark, sf_dir), views.articles_view(), QuerySpec(query, now=NOW, **more), key="doc_id")
        return stamped(out.select(*columns) if columns else out)

    return run


def times_of(phrase: str) -> str:
    """How often words stand in a row, without overlaps."""
    doubled = "replace(norm, ' ', '  ')"
    wanted = f" {'  '.join(phrase.split())} "
    return f"((length({doubled}) - length(replace({doubled}, '{wanted}', ''))) // {len(wanted)})"


def relevance(*phrases: str) -> str:
    return f"({' + '.join(map(times_of, phrases))}) / ln(2.718281828459045 + len(list_filter(string_split(norm, ' '), lambda x: x <> '')))"


def near_sql(a: str, b: str, n: int) -> str:
    gap = f"([^ ]+ ){{0,{n - 1}}}"
    return f"regexp_matches(norm, ' {a} {gap}{b} | {b} {gap}{a} ')"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec("theme:building", "pointdata", "7d", "2024-01-06 00:00:00", service="geo", geores=2, sort="date")
    return dispatch(views.mentions(spark, sf_dir), views.mentions_view(), spec)


def images_on_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec("theme:building", "imagepointdata", service="geo", sort="toneasc")
    return dispatch(views.image_mentions(spark, sf_dir), views.mentions_view(), spec)


def points_sql(rows: str, order: str, shown: str) -> str:
    return f"""{MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY country, adm1, level, lat, lon ORDER BY {order}, article_id) AS k FROM m WHERE theme = 'BUILDING' AND {rows})
SELECT country, adm1, level, lat, lon, count(*) AS n, list({shown} ORDER BY k) FILTER (k <= 5) AS articles FROM r GROUP BY country, adm1, level, lat, lon ORDER BY n DESC, adm1, level, lat, lon LIMIT 1000"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec('"the" market:"National"', "timelinevol", "6m", "2024-01-12 00:00:00", service="tv")
    return stamped(dispatch(views.clips(spark, sf_dir), views.clips_view(), spec))


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line asks for, as an export."""
    query = rewrite.build(rewrite.normalize("the and that"), source="United States", domain="src1.example.com")
    spec = QuerySpec(query, timespan="30d", now=NOW, maxrecords=50, sort="datedesc")
    return sinks.csv_row(dispatch(views.articles(spark, sf_dir), views.articles_view(), spec, key="doc_id"))


def image_search(mode: str, query: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = dispatch(views.pages(spark, sf_dir), views.pages_view(), QuerySpec(query, mode, maxrecords=60), key="page_id")
        return out.select(*columns) if columns else out

    return run


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document around the articles of a capped result, read back."""
    rows = as_articles(spark, sf_dir).where("page_id < 40")
    made = sinks.enveloped(sinks.article_row(rows), "recall", "articles", "7d", "hybridrel")
    part = lambda path: F.get_json_object("json", path)
    return made.select(part("$.query").alias("query"), part("$.count").cast("bigint").alias("n"), part("$.articles[0].url").alias("first"), part("$.articles[0].sourcecountry").alias("country"))


LABEL = "CASE WHEN tone > 2 THEN 'POSITIVE' WHEN tone > 0 THEN 'SLIGHTLY POSITIVE' WHEN tone > -2 THEN 'SLIGHTLY NEGATIVE' ELSE 'NEGATIVE' END"
SENTENCES = rf"""{ROWS}, s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+\s+') AS p FROM a WHERE {since("72 HOURS")}),
e AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, p[i] AS sentence FROM s, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
n AS (SELECT *, {NORM.replace("text", "sentence")} AS norm FROM e WHERE trim(sentence) <> '')
SELECT doc_id, sent_idx, CASE WHEN length(sentence) > 200 THEN left(sentence, 200) || '...' ELSE sentence END AS snippet FROM n
WHERE {OF_THE} AND {THAT} ORDER BY {relevance("of the", "that")} DESC, doc_id, sent_idx LIMIT 75"""

QUERIES = {
    "example_articles": (
        show('"of the" that sourcelang:english', "doc_id", "seendate", timespan="7d", maxrecords=25, sort="datedesc"),
        f"{ROWS} SELECT doc_id, strftime(seendate, {STAMP}) AS seendate FROM a WHERE {OF_THE} AND {THAT} AND {ENGLISH} AND {since('7 DAYS')} ORDER BY a.seendate DESC, doc_id LIMIT 25",
    ),
    "example_volume": (
        show('"of the" that sourcelang:english', mode="timelinevolraw", timespan="3m"),
        f"{ROWS} SELECT 'Article Count' AS series, strftime(date_trunc('day', seendate), {STAMP}) AS date, count(*) FILTER ({OF_THE} AND {THAT} AND {ENGLISH}) AS value, count(*) AS norm FROM a WHERE {since('3 MONTHS')} GROUP BY 2",
    ),
    "example_tone": (
        show('"of the" sourcelang:english', mode="timelinetone", timespan="30d"),
        f"{ROWS} SELECT 'Average Tone' AS series, strftime(date_trunc('day', seendate), {STAMP}) AS date, round(avg(tone), 6) AS value FROM a WHERE {OF_THE} AND {ENGLISH} AND {since('30 DAYS')} GROUP BY 2",
    ),
    "example_countries": (
        show('"of the" sourcelang:english', mode="timelinesourcecountry", timespan="30d"),
        f"""{ROWS}, c AS (SELECT sourcecountry AS series, date_trunc('day', seendate) AS day, count(*) FILTER ({OF_THE} AND {ENGLISH}) AS n, count(*) AS every FROM a WHERE {since('30 DAYS')} GROUP BY ALL),
t AS (SELECT *, sum(every) OVER (PARTITION BY day) AS total FROM c) SELECT series, strftime(day, {STAMP}) AS date, round(100.0::DOUBLE * n / total, 6) AS value FROM t WHERE n > 0""",
    ),
    "example_negative": (
        show('"of the" tone<-5 sourcelang:english', "doc_id", "tone", timespan="30d", maxrecords=50, sort="toneasc"),
        f"{ROWS} SELECT doc_id, tone FROM a WHERE {OF_THE} AND tone < -5 AND {ENGLISH} AND {since('30 DAYS')} ORDER BY tone, doc_id LIMIT 50",
    ),
    "example_any_of": (
        show('the (that OR was OR "of the" OR "in the") sourcelang:english', "doc_id", "seendate", timespan="30d", maxrecords=100, sort="datedesc"),
        f"""{ROWS} SELECT doc_id, strftime(seendate, {STAMP}) AS seendate FROM a WHERE contains(norm, ' the ') AND ({THAT} OR contains(norm, ' was ') OR {OF_THE} OR contains(norm, ' in the ')) AND {ENGLISH}
AND {since('30 DAYS')} ORDER BY a.seendate DESC, doc_id LIMIT 100""",
    ),
    "example_near": (
        show('near10:"of that" "of the" sourcelang:english', "doc_id", "score", timespan="30d", maxrecords=50),
        f"""{ROWS}, w AS (SELECT * FROM a WHERE {since('30 DAYS')}), v AS (SELECT domain, count(*) AS volume FROM w GROUP BY domain),
s AS (SELECT doc_id, round({relevance("of the")} + 0.1::DOUBLE * ln(1 + coalesce(volume, 0)), 6) AS score FROM w LEFT JOIN v USING (domain) WHERE {near_sql('of', 'that', 10)} AND {OF_THE} AND {ENGLISH})
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50""",
    ),
    "example_sentences": (show('"of the" that', "doc_id", "sent_idx", "snippet", service="context", timespan="72h", maxrecords=75), SENTENCES),
    "example_places": (places, points_sql("level >= 2 AND seendate BETWEEN TIMESTAMP '2023-12-30' AND TIMESTAMP '2024-01-06'", "seendate DESC", "article_id")),
    "example_captions": (
        captions,
        f"""{CLIPS} SELECT station AS series, strftime(date_trunc('day', date), {STAMP}) AS date, round(100.0::DOUBLE * count(*) FILTER (contains(norm, ' the ') AND market = 'National') / count(*), 6) AS value
FROM k WHERE date BETWEEN TIMESTAMP '2024-01-12' - INTERVAL 6 MONTHS AND TIMESTAMP '2024-01-12' GROUP BY 1, 2""",
    ),
    "example_client": (
        client,
        f"""{ROWS} SELECT strftime(seendate, '%Y-%m-%d %H:%M') AS "Date", title AS "Title", domain AS "Source", sourcecountry AS "SourceCountry", language AS "Language", url AS "URL" FROM a
WHERE contains(norm, ' the ') AND {THAT} AND {ENGLISH} AND sourcecountry = 'United States' AND domain = 'src1.example.com' AND {since('30 DAYS')} ORDER BY seendate DESC, doc_id LIMIT 50""",
    ),
    "geo_image_points": (
        images_on_places,
        points_sql("article_id % 4 = 0", "tone", "'http://example.com/' || article_id || '.jpg'"),
    ),
    "mode_image_gallery": (
        image_search("imagecollage", "imagenumfaces>1"),
        "SELECT page_id, 0::INTEGER AS place, 'Caption No. ' || (page_id % 9) AS ocrmeta, page_id * 13 % 100 AS webcount FROM pages WHERE page_id % 4 > 1 ORDER BY page_id LIMIT 60",
    ),
    "mode_image_info": (
        image_search("imagecollageinfo", "imagenumfaces>1", "page_id", "webcount", "numfaces", "tags"),
        "SELECT page_id, page_id * 13 % 100 AS webcount, CAST(page_id % 4 AS INTEGER) AS numfaces, ['tag' || (page_id % 7), 'kind' || (page_id % 3)] AS tags FROM pages WHERE page_id % 4 > 1 ORDER BY page_id LIMIT 60",
    ),
    "mode_image_cloud": (
        image_search("wordcloudimagewebtags", "imagenumfaces>1"),
        "SELECT 'web' || (page_id % 5) AS tag, count(*) AS n FROM pages WHERE page_id % 4 > 1 GROUP BY 1 ORDER BY n DESC, tag LIMIT 200",
    ),
    "tone_label": (
        lambda spark, d: views.coverage(spark, d).select("event_id", scalars.tone_label(F.col("tone")).alias("label")),
        f"{COVERAGE} SELECT event_id, {LABEL} AS label FROM c",
    ),
    "dedupe_url": (
        lambda spark, d: articles.dedupe(as_articles(spark, d), "domain", F.desc("seendate"), F.col("page_id")).select("domain", "page_id"),
        f"{ARTICLES} SELECT domain, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seendate DESC, page_id) AS k FROM p) WHERE k = 1",
    ),
    "json_envelope": (envelope, f"{ARTICLES} SELECT 'recall' AS query, count(*) AS n, min(url) AS first, coalesce(arg_min(sourcecountry, url), '') AS country FROM (SELECT url, coalesce(sourcecountry, '') AS sourcecountry FROM p WHERE page_id < 40)"),
}
