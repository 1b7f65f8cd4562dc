"""The warehouse's queries, as SQL over a view of coded events."""

from __future__ import annotations

from pyspark.sql import DataFrame

BY_COUNTRY = """
SELECT ActionGeo_CountryCode AS country, COUNT(*) AS events, ROUND(AVG(GoldsteinScale), 6) AS goldstein, ROUND(AVG(AvgTone), 6) AS tone
FROM {events} WHERE partition_date >= DATE '{start}' AND partition_date < DATE '{end}' AND ActionGeo_CountryCode IS NOT NULL
GROUP BY ActionGeo_CountryCode ORDER BY events DESC, country LIMIT {limit}"""

BY_ROOT_CODE = """
SELECT EventId, to_date(CAST(SQLDATE AS STRING), 'yyyyMMdd') AS day, ActionGeo_CountryCode AS country, NumArticles
FROM {events} WHERE EventRootCode = '{code}' ORDER BY NumArticles DESC, EventId LIMIT {limit}"""

TIMELINE = """
SELECT to_date(CAST(SQLDATE AS STRING), 'yyyyMMdd') AS day, COUNT(*) AS events, SUM(NumArticles) AS articles, ROUND(AVG(AvgTone), 6) AS tone
FROM {events} WHERE QuadClass = {quad} AND partition_date >= DATE '{start}' AND partition_date < DATE '{end}'
GROUP BY day ORDER BY day"""

ABOUT = """
SELECT EventId, SQLDATE, Actor1CountryCode, Actor2CountryCode, NumMentions
FROM {events} WHERE Actor1CountryCode = '{code}' OR Actor2CountryCode = '{other}' ORDER BY NumMentions DESC, EventId LIMIT {limit}"""

DAILY = """
SELECT to_date(CAST(SQLDATE AS STRING), 'yyyyMMdd') AS day, COUNT(*) AS events, ROUND(AVG(AvgTone), 6) AS tone
FROM {events} WHERE partition_date >= DATE '{start}' AND partition_date < DATE '{end}' GROUP BY day ORDER BY day"""


def run(events: DataFrame, sql: str, **values: object) -> DataFrame:
    """A statement over the view. Values are written into it: they come from the program, not from users."""
    spark = events.sparkSession
    return spark.sql(sql.format(events="{events}", **values), events=events)


def names(rows: DataFrame, crosswalk: DataFrame, code: str, crosswalk_code: str, name: str) -> DataFrame:
    """Rows with the name of their country; a code without one keeps its row. The optimizer broadcasts the crosswalk where its size allows."""
    known = crosswalk.select(crosswalk[crosswalk_code].alias("_code"), crosswalk[name].alias("country_name"))
    return rows.join(known, rows[code] == known["_code"], "left").drop("_code")
