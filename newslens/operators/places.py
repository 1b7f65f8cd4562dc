"""Aggregates over places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions import times

POINTS = {"pointdata": 1_000, "pointheatmap": 25_000, "pointanimation": 10_000}
PLACE = ("country", "adm1", "level", "lat", "lon")


def at_resolution(df: DataFrame, geores: int) -> DataFrame:
    """0: all places, 1: no countries, 2: cities only."""
    if geores not in (0, 1, 2):
        raise ValueError("geores is 0, 1 or 2")
    return df.where(F.col("level") >= geores)


def points(df: DataFrame, match: Column, articles: int = 5, most: int = POINTS["pointdata"], order: Sequence[Column] = (), named: str = "article_id") -> DataFrame:
    """Places with their number of matched articles and the first few of them in an order, named by a column."""
    rows = df.where(match)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*PLACE).orderBy(*order, "article_id"))).where(f"_n <= {articles}")
    lists = F.sort_array(F.collect_list(F.struct("_n", F.col(named).alias("v"))))
    named = first.groupBy(*PLACE).agg(F.transform(lists, lambda x: x["v"]).alias("articles"))
    counted = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(named, list(PLACE)).orderBy(F.desc("n"), "adm1", "level", "lat", "lon").limit(most)


def heatmap(df: DataFrame, match: Column, most: int = POINTS["pointheatmap"]) -> DataFrame:
    return df.where(match).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lat", "lon").limit(most)


def animation(df: DataFrame, match: Column, ts: str = "seendate", most: int = POINTS["pointanimation"]) -> DataFrame:
    """The heat map of each quarter hour."""
    steps = df.where(match).groupBy(times.bucket(F.col(ts), "15min").alias("date"), "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    ranked = steps.withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("n"), "lat", "lon")))
    return ranked.where(f"_n <= {most}").drop("_n")


def density(df: DataFrame, match: Column, *keys: str) -> DataFrame:
    """Matched mentions in percent of all mentions of a place."""
    return df.groupBy(*keys).agg(F.count_if(match).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("density", F.round(F.lit(100.0) * F.col("matched") / F.col("total"), 6))


def feature(name: Column, lat: Column, lon: Column, **properties: Column) -> Column:
    """A GeoJSON point; the longitude comes first."""
    props = F.struct(name.alias("name"), *[v.alias(k) for k, v in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def from_feature(json: Column) -> Column:
    """(name, lat, lon) of a GeoJSON point; a coordinate of 0 is a coordinate."""
    f = F.from_json(json, "properties struct<name:string>, geometry struct<coordinates:array<double>>")
    return F.struct(f["properties"]["name"].alias("name"), F.get(f["geometry"]["coordinates"], F.lit(1)).alias("lat"), F.get(f["geometry"]["coordinates"], F.lit(0)).alias("lon"))
