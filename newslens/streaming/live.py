"""Live feeds: timelines and deduplication over a stream, with items up to an hour late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone; the session's is UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATENESS)


def timeline(stream: DataFrame, match: Column, ts: str, width: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Matched and all items per window; a slide smooths."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed(stream, ts).groupBy(window.alias("w")).agg(F.count_if(match).alias("value"), F.count(F.lit(1)).alias("norm")).select(F.col("w.start").alias("date"), "value", "norm")


def distinct(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """The first item of each key; keys are kept for as long as items may be late."""
    return timed(stream, ts).dropDuplicatesWithinWatermark([key])


def spikes(points: DataFrame, n: int = 24, sigmas: float = 3.0) -> DataFrame:
    """Points of a timeline that stand out from the n before them."""
    from pyspark.sql import Window

    before = Window.partitionBy("series").orderBy("date").rowsBetween(-n, -1)
    mean, spread = F.avg("value").over(before), F.stddev_samp("value").over(before)
    return points.withColumn("z", F.round((F.col("value") - mean) / F.nullif(spread, F.lit(0.0)), 6)).where(F.col("z") > sigmas)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to parquet; run again, it goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
