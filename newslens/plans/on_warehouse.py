"""Queries over coded events, in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.operators import warehouse
from newslens.sources import views
from newslens.sources.tables import table

EVENTS = """WITH e AS (SELECT o_orderkey AS EventId, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS SQLDATE, CAST(o_orderdate AS DATE) AS day, upper(left(n_name, 3)) AS a1, 'C' || (o_orderkey % 25) AS a2, n_name AS country,
lpad(CAST(o_orderkey % 20 + 1 AS VARCHAR), 2, '0') AS code, o_orderkey % 4 + 1 AS quad, CAST(o_orderkey % 21 - 10 AS DOUBLE) AS goldstein, CAST(o_orderkey % 201 - 100 AS DOUBLE) AS tone,
CAST(o_orderkey % 50 + 1 AS INTEGER) AS articles, CAST(o_orderkey % 90 + 1 AS INTEGER) AS mentions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
YEAR = {"start": "1996-01-01", "end": "1997-01-01"}
IN_YEAR = "day >= DATE '1996-01-01' AND day < DATE '1997-01-01'"


def sql(text: str, **values: object):
    def run(spark, sf_dir):
        out = warehouse.run(views.warehouse(spark, sf_dir), text, **values)
        return out.withColumn("day", F.date_format("day", "yyyy-MM-dd")) if "day" in out.columns else out

    return run


def crosswalk(spark, sf_dir):
    events = views.warehouse(spark, sf_dir).groupBy("Actor1CountryCode").agg(F.count(F.lit(1)).alias("events"))
    names = table(spark, sf_dir, "nation").groupBy(F.upper(F.left("n_name", F.lit(3))).alias("code")).agg(F.min("n_name").alias("n_name"))
    return warehouse.names(events, names, "Actor1CountryCode", "code", "n_name")


def url_join(spark, sf_dir):
    """Events and their mentions, which share an address; line items stand for mentions."""
    events = views.warehouse(spark, sf_dir).where("EventRootCode = '14'").select("EventId", "SOURCEURL")
    mentions = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("http://example.com/"), F.col("l_orderkey").cast("string")).alias("url"), "l_quantity")
    return events.join(mentions, events["SOURCEURL"] == mentions["url"]).groupBy("EventId").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.sum("l_quantity"), 6).alias("weight"))


QUERIES = {
    "sql_by_country": (sql(warehouse.BY_COUNTRY, limit=25, **YEAR), f"{EVENTS} SELECT country, count(*) AS events, round(avg(goldstein), 6) AS goldstein, round(avg(tone), 6) AS tone FROM e WHERE {IN_YEAR} GROUP BY country ORDER BY events DESC, country LIMIT 25"),
    "sql_by_code": (sql(warehouse.BY_ROOT_CODE, code="14", limit=100), f"{EVENTS} SELECT EventId, strftime(day, '%Y-%m-%d') AS day, country, articles AS NumArticles FROM e WHERE code = '14' ORDER BY articles DESC, EventId LIMIT 100"),
    "sql_conflict_timeline": (sql(warehouse.TIMELINE, quad=4, **YEAR), f"{EVENTS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(articles) AS BIGINT) AS articles, round(avg(tone), 6) AS tone FROM e WHERE quad = 4 AND {IN_YEAR} GROUP BY e.day"),
    "sql_two_col_or": (sql(warehouse.ABOUT, code="IND", other="C7", limit=100), f"{EVENTS} SELECT EventId, SQLDATE, a1 AS Actor1CountryCode, a2 AS Actor2CountryCode, mentions AS NumMentions FROM e WHERE a1 = 'IND' OR a2 = 'C7' ORDER BY mentions DESC, EventId LIMIT 100"),
    "sql_daily": (sql(warehouse.DAILY, **YEAR), f"{EVENTS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS events, round(avg(tone), 6) AS tone FROM e WHERE {IN_YEAR} GROUP BY e.day"),
    "crosswalk_join": (crosswalk, f"{EVENTS}, n AS (SELECT upper(left(n_name, 3)) AS code, min(n_name) AS n_name FROM nation GROUP BY 1) SELECT a1 AS Actor1CountryCode, count(*) AS events, n_name AS country_name FROM e LEFT JOIN n ON a1 = n.code GROUP BY a1, n_name"),
    "event_mentions_join": (url_join, f"{EVENTS} SELECT EventId, count(*) AS mentions, round(sum(l_quantity), 6) AS weight FROM e JOIN lineitem ON l_orderkey = EventId WHERE code = '14' GROUP BY EventId"),
}
