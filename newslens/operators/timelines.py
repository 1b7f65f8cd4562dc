"""Timelines: matched and total coverage per bucket, tone, series, smoothing, gap filling, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions import scalars, times

SMOOTHING = (0, 30)


def volume_raw(df: DataFrame, match: Column, ts: str, width: str) -> DataFrame:
    """series, date, value, norm: matched and all rows per bucket, in one scan."""
    return df.groupBy(times.bucket(F.col(ts), width).alias("date")).agg(F.count_if(match).alias("value"), F.count(F.lit(1)).alias("norm")).select(F.lit("Article Count").alias("series"), "date", "value", "norm")


def percent(value: Column, norm: Column) -> Column:
    return F.round(F.lit(100.0) * value / F.nullif(norm, F.lit(0)), 6)


def volume(df: DataFrame, match: Column, ts: str, width: str) -> DataFrame:
    """series, date, value: matched rows in percent of all."""
    raw = volume_raw(df, match, ts, width)
    return raw.select(F.lit("Volume Intensity").alias("series"), "date", percent(F.col("value"), F.col("norm")).alias("value"))


def tone(df: DataFrame, match: Column, ts: str, width: str, tone_col: str = "tone") -> DataFrame:
    rows = df.where(match).groupBy(times.bucket(F.col(ts), width).alias("date")).agg(F.round(F.avg(tone_col), 6).alias("value"))
    return rows.select(F.lit("Average Tone").alias("series"), "date", "value")


def by_series(df: DataFrame, match: Column, ts: str, width: str, series: str) -> DataFrame:
    """One series per value of a column: its matched rows in percent of all rows of the bucket."""
    counts = df.groupBy(F.col(series).alias("series"), times.bucket(F.col(ts), width).alias("date")).agg(F.count_if(match).alias("n"), F.count(F.lit(1)).alias("all"))
    total = F.sum("all").over(Window.partitionBy("date"))
    return counts.withColumn("norm", total).where("n > 0").select("series", "date", percent(F.col("n"), F.col("norm")).alias("value"))


def with_articles(df: DataFrame, match: Column, ts: str, width: str, order: list[Column], article: Column, most: int = 10) -> DataFrame:
    """The volume, with the first articles of each bucket."""
    rows = df.withColumn("date", times.bucket(F.col(ts), width))
    ranked = rows.where(match).withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(*order))).where(f"_n <= {most}")
    lists = ranked.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", article.alias("article")))), lambda x: x["article"]).alias("articles"))
    totals = rows.groupBy("date").agg(F.count_if(match).alias("value"), F.count(F.lit(1)).alias("norm"))
    return totals.join(lists, "date", "left").select("date", percent(F.col("value"), F.col("norm")).alias("value"), "articles")


def smoothed(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """A trailing mean over n buckets of a series, or of all where there is one; 0 and 1 leave it as it is."""
    if not SMOOTHING[0] <= n <= SMOOTHING[1]:
        raise ValueError(f"smoothing is from {SMOOTHING[0]} to {SMOOTHING[1]}")
    if n < 2:
        return df
    trailing = Window.partitionBy(*[c for c in ("series",) if c in df.columns]).orderBy("date").rowsBetween(1 - n, 0)
    return df.withColumn(value, F.round(F.avg(value).over(trailing), 6))


def filled(df: DataFrame, start: str, end: str, interval: str, **zero: object) -> DataFrame:
    """All buckets from ``start`` to before ``end``; those without rows get the given values."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - {interval}, {interval})")).alias("date"))
    out = F.broadcast(grid).join(df, "date", "left")
    for c, v in zero.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def tone_chart(df: DataFrame, tone_col: str = "tone") -> DataFrame:
    """Rows per whole point of tone."""
    return df.groupBy(F.floor(F.col(tone_col)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tone_summary(points: DataFrame, zeros: bool = True, value: str = "value") -> DataFrame:
    """Mean, least, greatest and number of a timeline's points, with or without zeros, and the mean in words."""
    kept = points if zeros else points.where(F.col(value) != 0)
    out = kept.agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("points"))
    return out.withColumn("label", scalars.tone_label(F.col("mean")))


def peak(date: str, value: str) -> Column:
    """The first date with the greatest value."""
    return F.min_by(date, F.struct(-F.col(value), F.col(date)))


def last(points: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The last n points; ``place`` numbers them from the first of them."""
    newest = points.orderBy(F.desc(date)).limit(n)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(date)))


def volume_summary(points: DataFrame, date: str = "date", value: str = "value", periods: int | None = None) -> DataFrame:
    """Total, mean per point or per a fixed number of periods, peak and its first date, and number of points."""
    by = F.lit(float(periods)) if periods else F.nullif(F.count(value), F.lit(0)).cast("double")
    return points.agg(F.sum(value).cast("bigint").alias("total"), F.round(F.sum(value).cast("double") / by, 6).alias("average"), F.max(value).cast("bigint").alias("peak"), peak(date, value).alias("peak_date"), F.count(value).alias("points"))


def bars(points: DataFrame, width: int = 40, value: str = "value") -> DataFrame:
    """Lengths of bars against the greatest value; none if that is not above zero."""
    top = F.max(value).over(Window.partitionBy())
    return points.withColumn("bar", F.when(top > 0, F.floor(F.col(value) / top * width)).otherwise(F.lit(0)).cast("bigint"))


def series_totals(points: DataFrame, most: int, value: str = "value") -> DataFrame:
    """The series with the greatest sums."""
    return points.groupBy("series").agg(F.round(F.sum(value), 6).alias("total")).orderBy(F.desc("total"), "series").limit(most)


def most_common(df: DataFrame, key: str, most: int, first: str, missing: str = "?") -> DataFrame:
    """The most frequent values; of equals, the one that came first. Missing ones count as a value."""
    k = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(missing))
    return df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).orderBy(F.desc("n"), "first").limit(most).select("key", "n")


def daily(points: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    return points.groupBy(F.to_date(date).alias("day")).agg(F.sum(value).cast("bigint").alias("value"))


def flatten(response: DataFrame, first_only: bool = False) -> DataFrame:
    """series, date, value of a service's response; points that can't be read are left out."""
    line = response.select(F.explode(F.slice("timeline", 1, 1) if first_only else F.col("timeline")).alias("s"))
    point = line.select(F.col("s.series").alias("series"), F.explode("s.data").alias("p"))
    return point.select("series", F.col("p.date").alias("date"), F.col("p.value").cast("string").try_cast("double").alias("value")).where("date is not null and value is not null")


def nested(points: DataFrame, title: str, width: str) -> DataFrame:
    """A timeline as a service's response: one row with ``query_details`` and ``timeline``. For a capped result, at the end."""
    stamped = points.withColumn("date", times.stamp(F.col("date")))
    fields = [c for c in stamped.columns if c != "series"]
    data = F.transform(F.sort_array(F.collect_list(F.struct("date", F.struct(*fields).alias("p")))), lambda x: x["p"])
    line = stamped.groupBy("series").agg(data.alias("data"))
    details = F.struct(F.lit(title).alias("title"), F.lit(width).alias("date_resolution"))
    return line.agg(F.sort_array(F.collect_list(F.struct("series", "data"))).alias("timeline")).select(details.alias("query_details"), "timeline")
