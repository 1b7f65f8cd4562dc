"""Lists of articles: filter, rank, cap, dedupe, and collecting beyond a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions import text

#: Default and greatest number of records of each service.
LIMITS = {"doc": (75, 250), "context": (75, 200), "tv": (50, 3000)}
CLIENT_DEFAULT = 25
SORTS = {"doc": ("hybridrel", "datedesc", "dateasc", "toneasc", "tonedesc"), "context": ("hybridrel", "datedesc", "dateasc"), "geo": ("date", "tonedesc", "toneasc")}


def capped(limit: int | None, service: str = "doc") -> int:
    least, most = 1, LIMITS[service][1]
    n = LIMITS[service][0] if limit is None else limit
    if n < least:
        raise ValueError(f"a limit is from {least} to {most}")
    return min(n, most)


def sort_keys(sort: str, service: str = "doc", *, date: str = "seendate", tone: str = "tone", score: str = "score") -> Column:
    if sort not in SORTS.get(service, SORTS["doc"]):
        raise ValueError(f"{service} has no sort {sort!r}")
    return {
        "hybridrel": F.desc_nulls_last(score), "datedesc": F.desc_nulls_last(date), "date": F.desc_nulls_last(date), "dateasc": F.asc_nulls_last(date),
        "tonedesc": F.desc_nulls_last(tone), "toneasc": F.asc_nulls_last(tone),
    }[sort]


def top(df: DataFrame, sort: str, limit: int, key: str, service: str = "doc", **columns: str) -> DataFrame:
    """The first rows in an order; equals go by ``key``."""
    return df.orderBy(sort_keys(sort, service, **columns), key).limit(capped(limit, service))


def relevance(normed: Column, terms: list[str]) -> Column:
    """Term frequency against length. The services' formula is not published; this one is ours."""
    n = sum((text.occurrences(normed, t) for t in terms), F.lit(0).cast("bigint"))
    return n / F.log(F.lit(2.718281828459045) + F.size(text.tokens(normed)))


def hybrid(matched: DataFrame, everything: DataFrame, outlet: str | None, terms: list[str], weight: float = 0.1, norm: Column | str | None = "norm") -> DataFrame:
    """``matched`` with a score of relevance, and of the outlet's volume in ``everything``. A row without an outlet has no volume; without a text, ``norm`` is None and volume alone counts."""
    score = F.lit(0.0) if norm is None else relevance(F.col(norm) if isinstance(norm, str) else norm, terms)
    if outlet is None:
        return matched.withColumn("score", F.round(score, 6))
    volume = everything.where(F.col(outlet).isNotNull()).groupBy(F.col(outlet).alias("_outlet")).agg(F.count(F.lit(1)).alias("_volume"))
    rows = matched.join(volume, F.col(outlet) == F.col("_outlet"), "left")
    return rows.withColumn("score", F.round(score + weight * F.log1p(F.coalesce("_volume", F.lit(0)).cast("double")), 6)).drop("_outlet", "_volume")


def dedupe(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first in an order, as survivors must not depend on chance."""
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def over_cap(df: DataFrame, date: str, cap: int = LIMITS["doc"][1]) -> DataFrame:
    """Days with their number of rows, and whether a service's cap would cut them."""
    days = df.groupBy(F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("split", F.col("n") > cap)


#: Minutes of the windows that a day is cut into, where it holds too much; each is a whole part of the one before.
WIDTHS = (1440, 720, 360, 180, 90, 45, 15)


def split_windows(df: DataFrame, date: str, cap: int = LIMITS["doc"][1]) -> DataFrame:
    """Windows whose rows fit under a cap: days, cut finer where they hold more, down to quarter hours.

    All depths are counted at once from quarter hours; a window counts if it fits
    and the one around it does not, or if it is the narrowest.
    """
    minute = F.hour(date) * 60 + F.minute(date)
    fine = df.groupBy(F.to_date(date).alias("day"), F.floor(minute / WIDTHS[-1]).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.lit(w).alias("minutes")) for k, w in enumerate(WIDTHS)]))
    begin = (F.floor(F.col("slot") * WIDTHS[-1] / F.col("x.minutes")) * F.col("x.minutes")).cast("int")
    every = fine.withColumn("x", depths).groupBy("day", "x.depth", "x.minutes", begin.alias("from_minute")).agg(F.sum("n").alias("n"))
    wider = F.get(F.array(*map(F.lit, WIDTHS)), F.col("depth") - 1)
    full = every.where(F.col("n") > cap).select(F.col("day").alias("_day"), (F.col("depth") + 1).alias("_depth"), F.col("from_minute").alias("_from"))
    around = F.when(F.col("depth") > 0, F.floor(F.col("from_minute") / wider) * wider)
    cut = every.withColumn("around", around).join(full, (F.col("day") == F.col("_day")) & (F.col("depth") == F.col("_depth")) & (F.col("around") == F.col("_from")), "left")
    fits = (F.col("n") <= cap) | (F.col("depth") == len(WIDTHS) - 1)
    return cut.where(fits & ((F.col("depth") == 0) | F.col("_day").isNotNull())).select("day", "from_minute", "minutes", "n")
