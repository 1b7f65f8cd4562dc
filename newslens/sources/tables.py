"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one parquet table under ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_by_day(df: DataFrame, path: str, day: str) -> None:
    """A table with one folder per day, so that a range of days reads no others."""
    df.repartition(day).write.mode("overwrite").partitionBy(day).parquet(path)


def between_days(spark: SparkSession, path: str, day: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to before ``end``; only the folders of these days are read."""
    return spark.read.parquet(path).where(f"{day} >= DATE '{start}' AND {day} < DATE '{end}'")
