"""One entry for all modes: a query specification over a prepared view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import times
from newslens.operators import articles, broadcasts, context, places, tags, timelines

from .query import View, matches, parse, terms


@dataclass(frozen=True)
class QuerySpec:
    """What to search and how to show it. ``now`` is the end of a relative time span; either absolute bound may be missing."""

    query: str
    mode: str = "artlist"
    timespan: str | None = None
    now: str | None = None
    start: str | None = None
    end: str | None = None
    maxrecords: int | None = None
    sort: str = "hybridrel"
    smoothing: int = 0
    service: str = "doc"
    #: Context: quoted sentences only. Geo: least resolution, most points. TV: width, counts instead of percent, all stations as one.
    isquote: bool = False
    geores: int = 0
    maxpoints: int | None = None
    dateres: str = "day"
    raw: bool = False
    combined: bool = False

    def __post_init__(self) -> None:
        if self.timespan and (self.start or self.end):
            raise ValueError("a time span and absolute bounds exclude each other")
        if self.timespan and not self.now:
            raise ValueError("a time span needs its end")


SERIES = {"timelinelang": "language", "timelinesourcecountry": "sourcecountry"}
TIMELINES = ("timelinevolraw", "timelinevol", "timelinevolinfo", "timelinetone", *SERIES)
#: Modes that show the images of articles; the last tells what is known of each.
GALLERIES = ("artgallery", "imagegallery", "imagecollage", "imagecollagesharei", "imagecollageinfo")
CLOUDS = {"wordcloudimagetags": "tags", "wordcloudimagewebtags": "webtags"}


def within(df: DataFrame, spec: QuerySpec, date: str) -> DataFrame:
    """The rows in the specification's time window, cut to what its service offers."""
    if not (spec.timespan or spec.start or spec.end):
        return df
    if date not in df.columns:
        raise ValueError(f"a time window needs a column {date!r}")
    if spec.timespan:
        return df.where(times.relative(F.col(date), times.clamped(spec.timespan, spec.service), spec.now))
    return df.where(times.TimeWindow.absolute(spec.start, spec.end).holds(F.col(date)))


def width_of(spec: QuerySpec) -> str:
    """Width of a timeline's buckets; that of the service's longest window where a window has an open end."""
    if spec.timespan:
        return times.resolution(times.seconds(times.clamped(spec.timespan, spec.service)))
    length = times.TimeWindow.absolute(spec.start, spec.end).length()
    return times.resolution(times.SERVICE_WINDOW["doc"] if length is None else length)


def scored(df: DataFrame, match: Column, view: View, spec: QuerySpec, outlet: str) -> DataFrame:
    """Matched rows with a score: relevance where the view has a text, and the outlet's volume where there is one."""
    words = terms(parse(spec.query))
    return articles.hybrid(df.where(match), df, outlet if outlet in df.columns else None, words, norm=view.norm)


def run(df: DataFrame, view: View, spec: QuerySpec, *, date: str = "seendate", key: str = "event_id", outlet: str = "domain") -> DataFrame:
    """Articles, timelines, images and tags of a specification over ``df``, whose columns the view names."""
    df = within(df, spec, date)
    match = matches(spec.query, view)
    if spec.mode == "artlist":
        ranked = scored(df, match, view, spec, outlet) if spec.sort == "hybridrel" and "score" not in df.columns else df.where(match)
        return articles.top(ranked, spec.sort, spec.maxrecords, key, spec.service, date=date).drop(*view.hidden)
    if spec.mode in CLOUDS:
        return tags.cloud(df, match, CLOUDS[spec.mode])
    if spec.mode in GALLERIES:
        return tags.gallery(df, match, key, articles.capped(spec.maxrecords), info=spec.mode == "imagecollageinfo")
    if spec.mode == "tonechart":
        return timelines.tone_chart(df.where(match))
    if spec.mode not in TIMELINES:
        raise ValueError(f"no mode {spec.mode!r}")
    width = width_of(spec)
    if spec.mode == "timelinevolraw":
        out = timelines.volume_raw(df, match, date, width)
    elif spec.mode == "timelinevolinfo":
        out = timelines.with_articles(df, match, date, width, [F.desc(date), F.col(key)], F.col(key))
    elif spec.mode == "timelinetone":
        out = timelines.tone(df, match, date, width)
    elif spec.mode == "timelinevol":
        out = timelines.volume(df, match, date, width)
    else:
        out = timelines.by_series(df, match, date, width, SERIES[spec.mode])
    return timelines.smoothed(out, spec.smoothing)


def run_context(docs: DataFrame, view: View, spec: QuerySpec, *, date: str = "seendate", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences that match. ``docs`` need a text; a date only for a time window and the sorts by date."""
    found = context.search(within(docs, spec, date), spec.query, view, spec.isquote)
    most = articles.capped(spec.maxrecords, "context")
    if spec.sort == "hybridrel" and "score" not in found.columns:
        found = found.withColumn("score", articles.relevance(F.col("norm"), terms(parse(spec.query))))
    return found.orderBy(articles.sort_keys(spec.sort, "context", date=date), key, "sent_idx").limit(most).drop("norm", *view.hidden)


def run_geo(mentions: DataFrame, view: View, spec: QuerySpec, *, date: str = "seendate", image: str = "image") -> DataFrame:
    """Places of matched articles, by mode. The image modes look at mentions with an image, where there is a column of them, and name images instead of articles."""
    df = places.at_resolution(within(mentions, spec, date), spec.geores)
    match = matches(spec.query, view)
    most = lambda mode: min(spec.maxpoints or places.POINTS[mode], places.POINTS[mode])
    mode, named = spec.mode.removeprefix("image"), "article_id"
    if mode != spec.mode and image in df.columns:
        df, named = df.where(F.col(image).isNotNull()), image
    order = [] if spec.sort == "hybridrel" else [articles.sort_keys(spec.sort, "geo", date=date)]
    if mode == "pointdata":
        return places.points(df, match, most=most("pointdata"), order=order, named=named)
    if mode == "pointheatmap":
        return places.heatmap(df, match, most("pointheatmap"))
    if mode == "pointanimation":
        return places.animation(df, match, date, most=most("pointanimation"))
    keys = {"country": ("country",), "adm1": ("adm1",), "sourcecountry": ("region", "country")}
    if mode not in keys:
        raise ValueError(f"no mode {spec.mode!r}")
    return places.density(df, match, *keys[mode])


def run_tv(clips: DataFrame, view: View, spec: QuerySpec, *, date: str = "date") -> DataFrame:
    """Clips and charts, by mode. Trending topics compare the time window with all time before it."""
    match = matches(spec.query, view)
    if spec.mode == "trendingtopics":
        if not (spec.start or spec.timespan):
            raise ValueError("trending topics need a time window")
        return broadcasts.trending(clips, times.TimeWindow.absolute(spec.start, None).start or times.before(spec.now, spec.timespan))
    clips = within(clips, spec, date)
    if spec.mode == "clipgallery":
        return clips.where(match).orderBy(F.desc(date), "broadcast", "clip").limit(articles.capped(spec.maxrecords, "tv")).drop(*view.hidden)
    if spec.mode == "timelinevol":
        return timelines.smoothed(broadcasts.timeline(clips, match, spec.dateres, spec.raw, spec.combined), spec.smoothing)
    if spec.mode == "timelinevolnorm":
        return broadcasts.airtime(clips, spec.dateres)
    if spec.mode == "stationdetails":
        return broadcasts.details(clips)
    charts = {"showchart": broadcasts.shows, "stationchart": broadcasts.stations, "wordcloud": broadcasts.word_cloud}
    if spec.mode not in charts:
        raise ValueError(f"no mode {spec.mode!r}")
    return charts[spec.mode](clips, match)


SERVICES = {"doc": run, "context": run_context, "geo": run_geo, "tv": run_tv}


def dispatch(df: DataFrame, view: View, spec: QuerySpec, **columns: str) -> DataFrame:
    """The result of a specification, by its service."""
    if spec.service not in SERVICES:
        raise ValueError(f"no service {spec.service!r}")
    return SERVICES[spec.service](df, view, spec, **columns)
