"""Logical views of the tables that the engine searches.

Columns that the tables lack are whole-number arithmetic on columns that they
have; such columns are synthetic and carry no meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions import scalars, text
from newslens.plans.query import View, any_of, country, equals, member, number, subdomain, text_of

from .prepared import preparable
from .tables import table


def key(column: str, name: str | None = None) -> Column:
    """A folded copy of a column, for conditions."""
    return F.lower(F.col(column)).alias(name or f"{column}_key")


def folded(**fields: str) -> dict:
    """Fields that compare the folded copies of columns."""
    return {field: equals(F.col(f"{c}_key"), folded=True) for field, c in fields.items()}


def keys(*columns: str) -> tuple[str, ...]:
    return tuple(f"{c}_key" for c in columns)


@preparable("lang_key", "source_key")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their normalised text; themes are made of source and language."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", "n_chars", "text", text.norm(F.col("text")).alias("norm"), F.array(F.col("source"), F.concat(F.lit("LANG_"), F.upper("lang"))).alias("themes"), key("lang"), key("source"))


def documents_view() -> View:
    return View(F.col("norm"), {**folded(sourcelang="lang", source="source", domainis="source"), "theme": member(F.col("themes"))}, hidden=keys("lang", "source"))


# Languages by their code.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


@preparable("language_key", "seendate")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: host, country, tone and date are synthetic, a title is how the text begins."""
    k = F.col("doc_id")
    at = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")) - F.make_dt_interval(F.lit(0), F.lit(0), (k * 37 % 129600).cast("int"))
    language = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.col("lang"))
    rows = documents(spark, sf_dir).select(
        "doc_id", "text", "norm", F.concat(F.lit("http://example.com/"), k.cast("string")).alias("url"), F.left("text", F.lit(60)).alias("title"), at.alias("seendate"), language.alias("language"),
        F.concat("source", F.lit(".example.com")).alias("domain"), F.when(k % 3 == 0, "France").when(k % 3 == 1, "United States").alias("sourcecountry"), ((k * 13 % 41 - 20) / F.lit(2.0)).alias("tone"),
    )
    return rows.select("*", key("language"), key("domain"), scalars.country_key(F.col("sourcecountry")).alias("sourcecountry_key"))


def articles_view() -> View:
    tone = F.col("tone")
    fields = {"sourcecountry": country(F.col("sourcecountry_key"), folded=True), "domain": subdomain(F.col("domain_key")), "tone": number(tone), "toneabs": number(F.abs(tone))}
    return View(F.col("norm"), {**folded(sourcelang="language", domainis="domain"), **fields}, hidden=keys("language", "domain", "sourcecountry"))


@preparable("host_key")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with host, and synthetic images."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    tag = lambda prefix, k: F.concat(F.lit(prefix), (n % k).cast("string"))
    image = F.struct(
        F.array(tag("tag", 7), tag("kind", 3)).alias("tags"), F.array(tag("web", 5)).alias("webtags"), F.concat(F.lit("Caption No. "), (n % 9).cast("string")).alias("ocrmeta"),
        (n % 5 - 2).cast("double").alias("facetone"), (n % 4).cast("int").alias("numfaces"), (n * 13 % 100).alias("webcount"),
    )
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = p.select("page_id", "url", scalars.host(F.col("url")).alias("host"), title.alias("title"), F.array(image).alias("images"))
    return rows.select("*", key("host"))


def pages_view() -> View:
    images = F.col("images")
    pick = lambda name: lambda x: number(x[name])
    return View(
        text.norm(F.col("title")),
        {
            "domain": subdomain(F.col("host_key")), **folded(domainis="host"),
            "imagetag": any_of(images, lambda x: member(x["tags"])), "imagewebtag": any_of(images, lambda x: member(x["webtags"])), "imageocrmeta": any_of(images, text_of(lambda x: x["ocrmeta"])),
            "imagefacetone": any_of(images, pick("facetone")), "imagenumfaces": any_of(images, pick("numfaces")), "imagewebcount": any_of(images, pick("webcount")),
        },
        hidden=keys("host"),
    )


@preparable("language_key", "seendate")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles in time: the series is the event's type, tone and language are synthetic."""
    e = table(spark, sf_dir, "events")
    lang = F.element_at(F.array(*map(F.lit, ("English", "French", "German", "Spanish"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("seendate"), F.col("event_type").alias("series"), (F.col("value") - 50).alias("tone"), lang.alias("language"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"))
    return rows.select("*", key("language"), key("series"), key("domain"))


def coverage_view() -> View:
    tone = F.col("tone")
    fields = {"domain": subdomain(F.col("domain_key")), "tone": number(tone), "toneabs": number(F.abs(tone))}
    return View(None, {**folded(sourcelang="language", theme="series", domainis="domain"), **fields}, hidden=keys("language", "series", "domain"))


@preparable("theme_key", "country_key")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as mentions of places: country and region are theirs, coordinates, level and second-level codes are synthetic."""
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    rows = c.join(places, c["c_nationkey"] == places["n_nationkey"]).select(
        k.alias("article_id"), "country", "region", F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("cc"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("A"), (k % 5).cast("string")).alias("adm1"),
        (k % 3).cast("int").alias("level"), (F.col("n_nationkey") * 7 - 80 + k % 3).cast("double").alias("lat"), (F.col("n_nationkey") * 14 - 170 + k % 5).cast("double").alias("lon"),
        F.col("c_mktsegment").alias("theme"), (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), (k * 37 % 10080).cast("int"))).alias("seendate"),
        ((k * 7) % 21 - 10).cast("double").alias("tone"),
    )
    return rows.select("*", key("theme"), key("country", "location_key"), scalars.country_key(F.col("country")).alias("country_key"), key("cc"), key("adm1"))


def image_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with the image of their article, where it has one; images are synthetic."""
    k = F.col("article_id")
    return mentions(spark, sf_dir).withColumn("image", F.when(k % 4 == 0, F.concat(F.lit("http://example.com/"), k.cast("string"), F.lit(".jpg"))))


def mentions_view() -> View:
    return View(
        None,
        {
            **folded(theme="theme", location="location", locationadm1="adm1"), "locationcc": country(F.col("country_key"), F.col("cc_key"), folded=True),
            "sourcecountry": country(F.col("country_key"), folded=True), "tone": number(F.col("tone")),
        },
        F.col("lat"),
        F.col("lon"),
        keys("theme", "location", "country", "cc", "adm1"),
    )


@preparable("station_key", "date")
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as captions: a conversation is a broadcast, a turn its 15-second clip, the role its station; dates, shows, networks and markets are synthetic."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), (k % 480).cast("int"), F.lit(0), (F.col("turn") * 15).cast("decimal(18,6)"))
    return c.select(
        k.alias("broadcast"), F.col("turn").alias("clip"), F.col("role").alias("station"), F.concat(F.lit("show"), (k % 13).cast("string")).alias("show"), F.concat(F.lit("net"), (k % 3).cast("string")).alias("network"),
        F.when(k % 2 == 0, "National").otherwise("Local").alias("market"), at.alias("date"), F.col("text").alias("snippet"), text.norm(F.col("text")).alias("norm"),
    ).select("*", *[key(x) for x in ("station", "network", "show", "market")])


def clips_view() -> View:
    names = ("station", "network", "show", "market")
    return View(F.col("norm"), folded(**{x: x for x in names}), hidden=keys(*names))


def warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as coded events; the codes are synthetic but for the country."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("o_orderkey")
    rows = o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("EventId"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("SQLDATE"), F.to_date("o_orderdate").alias("partition_date"),
        F.upper(F.left("n_name", F.lit(3))).alias("Actor1CountryCode"), F.concat(F.lit("C"), (k % 25).cast("string")).alias("Actor2CountryCode"), F.col("n_name").alias("ActionGeo_CountryCode"),
        F.lpad((k % 20 + 1).cast("string"), 2, "0").alias("EventRootCode"), (k % 4 + 1).cast("int").alias("QuadClass"), (k % 21 - 10).cast("double").alias("GoldsteinScale"),
        (k % 201 - 100).cast("double").alias("AvgTone"), (k % 50 + 1).cast("int").alias("NumArticles"), (k % 90 + 1).cast("int").alias("NumMentions"),
        F.concat(F.lit("http://example.com/"), k.cast("string")).alias("SOURCEURL"),
    )
