"""Tags of images, and themes that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cloud(df: DataFrame, match: Column, field: str, most: int = 200) -> DataFrame:
    """The most frequent tags of the images of matched rows."""
    tags = df.where(match).select(F.explode("images").alias("i")).select(F.explode(F.col(f"i.{field}")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def gallery(df: DataFrame, match: Column, key: str, most: int, info: bool = False) -> DataFrame:
    """The images of matched rows, by key and place; with ``info`` what is known of each."""
    images = df.where(match).select(key, F.posexplode("images").alias("place", "i"))
    shown = ("ocrmeta", "webcount", "numfaces", "facetone", "tags", "webtags") if info else ("ocrmeta", "webcount")
    return images.orderBy(key, "place").limit(most).select(key, "place", *[F.col(f"i.{c}") for c in shown])


def together(df: DataFrame, themes: str) -> DataFrame:
    """How many rows have each two themes."""
    a = df.select(F.array_sort(F.array_distinct(themes)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice(F.col("t"), i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("theme"), y.alias("other")))))
    return a.select(F.explode(pairs).alias("p")).groupBy("p.theme", "p.other").agg(F.count(F.lit(1)).alias("n"))
