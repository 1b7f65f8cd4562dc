"""Captions: clips, and charts over stations and shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions import text, times

CLIP_SECONDS = 15
WIDTHS = ("hour", "day", "week", "month", "year")


def in_context(df: DataFrame, match: Column) -> DataFrame:
    """Clips that match, or whose neighbour in the broadcast does."""
    order = Window.partitionBy("broadcast").orderBy("clip")
    hit = match.cast("int")
    near = lambda step: (F.coalesce(step(hit, 1).over(order), F.lit(0)) == 1) & (F.abs(step(F.col("clip"), 1).over(order) - F.col("clip")) == 1)
    return df.withColumn("_hit", match | F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False))).where("_hit").drop("_hit")


def timeline(df: DataFrame, match: Column, width: str, raw: bool = False, combined: bool = False) -> DataFrame:
    """Matched clips per station, or over all stations, in percent of all of them or as a count."""
    if width not in WIDTHS:
        raise ValueError(f"a width is one of {WIDTHS}")
    series = F.lit("Combined") if combined else F.col("station")
    rows = df.groupBy(series.alias("series"), times.bucket(F.col("date"), width).alias("date")).agg(F.count_if(match).alias("n"), F.count(F.lit(1)).alias("all"))
    value = F.col("n").cast("double") if raw else F.round(F.lit(100.0) * F.col("n") / F.col("all"), 6)
    return rows.select("series", "date", value.alias("value"))


def airtime(df: DataFrame, width: str) -> DataFrame:
    """Seconds watched per station."""
    return df.groupBy(F.col("station").alias("series"), times.bucket(F.col("date"), width).alias("date")).agg((F.count(F.lit(1)) * CLIP_SECONDS).alias("value"))


def shows(df: DataFrame, match: Column, most: int = 10) -> DataFrame:
    return df.where(match).groupBy("show").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "show").limit(most)


def stations(df: DataFrame, match: Column) -> DataFrame:
    """Each station's share of the attention."""
    per = df.groupBy("station").agg(F.count_if(match).alias("n"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6))


def details(df: DataFrame) -> DataFrame:
    return df.groupBy("station", "network", "market").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def word_cloud(df: DataFrame, match: Column, most: int = 200) -> DataFrame:
    words = df.where(match).select(F.explode(text.tokens(F.col("norm"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)


def trending(df: DataFrame, since: str, most: int = 25, least: int = 5) -> DataFrame:
    """Words by how much more frequent they are since a time than before, with one added to each count. The services' way is not published; this one is ours."""
    recent = F.col("date") >= F.lit(since).cast("timestamp_ntz")
    words = df.select(recent.alias("recent"), F.explode(text.tokens(F.col("norm"))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("recent").alias("recent"), F.count_if(~F.col("recent")).alias("before")).where(f"recent >= {least}")
    scored = counts.withColumn("ratio", F.round((F.col("recent") + 1) / (F.col("before") + 1).cast("double"), 6))
    return scored.orderBy(F.desc("ratio"), "word").limit(most)
