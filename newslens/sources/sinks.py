"""Result formats: CSV, JSON envelope, JSONP, JSON feed, RSS, GeoJSON. Columns are made by Spark; files of a capped result are written by the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from html import escape
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import times

CSV_COLUMNS = ("Date", "Title", "Source", "SourceCountry", "Language", "URL")
ARTICLE = ("url", "url_mobile", "title", "seendate", "socialimage", "domain", "language", "sourcecountry")
BOM = "﻿"


def article_row(df: DataFrame) -> DataFrame:
    """The fields of an article, with empty text for what is missing; the date as the services write it."""
    have = set(df.columns)
    stamp = lambda c: times.stamp(F.col(c)) if c == "seendate" else F.col(c).cast("string")
    return df.select(*[F.coalesce(stamp(c) if c in have else F.lit(None).cast("string"), F.lit("")).alias(c) for c in ARTICLE])


def csv_row(df: DataFrame) -> DataFrame:
    """The six columns of an export; ``seendate`` is a time."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        F.coalesce(times.minute(F.col("seendate")), F.lit("")).alias("Date"), text("title").alias("Title"), text("domain").alias("Source"),
        text("sourcecountry").alias("SourceCountry"), text("language").alias("Language"), text("url").alias("URL"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, written by the tasks."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def csv_text(df: DataFrame, bom: bool = False) -> str:
    """A capped result as one CSV text; with a byte-order mark, as the services send it."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(tuple(r) for r in df.toLocalIterator())
    return (BOM if bom else "") + out.getvalue()


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def envelope(rows: Iterable[str], query: str, mode: str, timespan: str, sort: str) -> str:
    """The JSON document around the articles of a capped result."""
    articles = [json.loads(r) for r in rows]
    return json.dumps({"query": query, "mode": mode, "timespan": timespan, "sort": sort, "count": len(articles), "articles": articles}, indent=2, ensure_ascii=False)


def jsonp(payload: Column, callback: str) -> Column:
    if not re.fullmatch(r"[A-Za-z_$][\w$.]*", callback):
        raise ValueError(f"not a function's name: {callback!r}")
    return F.concat(F.lit(callback + "("), payload, F.lit(")"))


def indented(payload: str) -> str:
    return json.dumps(json.loads(payload), indent=2, ensure_ascii=False)


def preview(payload: str, lines: int = 20) -> str:
    """The first lines of a JSON text, indented."""
    rows = indented(payload).split("\n")
    return "\n".join([*islice(rows, lines), *(["..."] if len(rows) > lines else [])])


def feed_item(df: DataFrame) -> Column:
    """An item of a JSON feed."""
    have = set(df.columns)
    image = [F.col("socialimage").alias("image")] if "socialimage" in have else []
    return F.to_json(F.struct(F.col("url").alias("id"), F.col("url"), F.col("title"), F.date_format("seendate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"), *image))


def json_feed(items: Iterable[str], title: str) -> str:
    return json.dumps({"version": "https://jsonfeed.org/version/1", "title": title, "items": [json.loads(i) for i in items]}, ensure_ascii=False)


def rss(rows: Iterable[dict], title: str, archive: bool = False) -> str:
    """RSS 2.0; the archive form adds the mobile address."""
    out = []
    for r in rows:
        more = f"<mobileurl>{escape(r.get('url_mobile') or '')}</mobileurl>" if archive else ""
        out.append(f"<item><title>{escape(r.get('title') or '')}</title><link>{escape(r['url'])}</link><pubDate>{escape(str(r.get('seendate') or ''))}</pubDate>{more}</item>")
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title>{"".join(out)}</channel></rss>'


def feature_collection(features: Iterable[str]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(f) for f in features]}, ensure_ascii=False)


def enveloped(rows: DataFrame, query: str, mode: str, timespan: str, sort: str) -> DataFrame:
    """The JSON document around the articles of a capped result, in the order of their addresses, as one row."""
    found = F.sort_array(F.collect_list(F.struct("url", *[c for c in rows.columns if c != "url"])))
    head = [F.lit(v).alias(k) for k, v in (("query", query), ("mode", mode), ("timespan", timespan), ("sort", sort))]
    return rows.agg(found.alias("a")).select(F.to_json(F.struct(*head, F.size("a").alias("count"), F.col("a").alias("articles"))).alias("json"))
