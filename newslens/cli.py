"""Command line: ``python -m newslens.cli "a or b" --table PATH --mode timeline``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from newslens.functions import scalars, times
from newslens.operators import articles, timelines
from newslens.plans import rewrite
from newslens.plans.query import QueryError, View, country, equals, member, number, parse, subdomain
from newslens.plans.run import QuerySpec, run, width_of
from newslens.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Search a table of articles.")
    p.add_argument("search")
    p.add_argument("--table", required=True, help="parquet table of articles")
    p.add_argument("--now", help="end of the time span, YYYY-MM-DD HH:MM:SS; else the newest article")
    p.add_argument("--country")
    p.add_argument("--source")
    p.add_argument("--domain")
    p.add_argument("--days", type=int)
    p.add_argument("--timespan", "-t")
    p.add_argument("--limit", type=int, default=articles.CLIENT_DEFAULT)
    p.add_argument("--mode", "-m", choices=sorted(rewrite.MODES), default="articles")
    p.add_argument("--sort", "-s", choices=sorted(rewrite.SORTS), default="relevance")
    p.add_argument("--csv")
    p.add_argument("--json", action="store_true")
    return p


def view(columns: list[str]) -> View:
    """The fields of a table of articles, as far as it has them."""
    from newslens.functions import text

    fields = {"sourcelang": ("language", equals), "sourcecountry": ("sourcecountry", country), "domain": ("domain", subdomain), "domainis": ("domain", equals), "theme": ("themes", member), "tone": ("tone", number)}
    made = {k: make(F.col(c)) for k, (c, make) in fields.items() if c in columns}
    if "tone" in columns:
        made["toneabs"] = number(F.abs("tone"))
    body = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "body") if c in columns]
    return View(text.norm(F.concat_ws(" ", *body)), made)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    say = lambda *x: print(*x, file=sys.stderr)
    terms = rewrite.normalize(args.search)
    if terms != args.search and not args.json:
        say(f"Searching for: {terms}")
    if args.csv and args.mode != "articles":
        say("--csv is for articles only and is ignored.")
        args.csv = None
    span = times.effective_timespan(args.timespan, args.days)
    query = rewrite.build(terms, args.country, args.source, args.domain)
    try:
        parse(query)
        times.interval_sql(span)
    except (QueryError, ValueError) as e:
        say(f"error: {e}")
        return 1
    if spark is None:
        from newslens.session import local_session

        spark = local_session()
    df = spark.read.parquet(args.table)
    df = df.withColumn("seendate", F.col("seendate").cast("timestamp_ntz")) if dict(df.dtypes)["seendate"] != "string" else df.withColumn("seendate", times.parse_stamp(F.col("seendate")))
    now = args.now or str(df.agg(F.max("seendate").alias("t")).first()["t"])
    shown = view(df.columns)
    spec = QuerySpec(query, rewrite.MODES[args.mode], span, now, maxrecords=args.limit, sort=rewrite.SORTS[args.sort])
    try:
        found = run(df, shown, spec, key="url")
        if args.mode == "articles":
            found = found.cache()
            if args.json:
                rows = [r["json"] for r in sinks.json_rows(sinks.article_row(found)).collect()]
                print(sinks.envelope(rows, query, args.mode, span, spec.sort))
                return 0
            if not found.count():
                say("No articles found.")
                return 0
            if args.csv:
                with open(args.csv, "w", encoding="utf-8", newline="") as f:
                    f.write(sinks.csv_text(sinks.csv_row(found)))
            for k, r in enumerate(sinks.article_row(found).collect(), 1):
                when = times.datetime.strptime(r["seendate"], times.STAMP).strftime("%Y-%m-%d %H:%M") if r["seendate"] else "N/A"
                print(scalars.display(" | ".join(x for x in (f"{k}. {r['title'] or 'Untitled'}", r["domain"] or "Unknown", when, r["sourcecountry"], r["url"]) if x)))
            return 0
        if args.json:
            print(sinks.indented(sinks.json_rows(timelines.nested(found, query, width_of(spec))).first()["json"]))
        elif args.mode == "tone":
            r = timelines.tone_summary(found).first()
            print(f"Average {r['mean']:+.2f} ({r['label']}), from {r['low']:+.2f} to {r['high']:+.2f}, {r['points']} points" if r["points"] else "No tone found.")
        else:
            tail = timelines.bars(timelines.last(found, 15)).orderBy("date").collect()
            for r in tail:
                print(f"{r['date']:%Y-%m-%d} | {r['value']:5d} | {'#' * r['bar']}")
            s = timelines.volume_summary(timelines.last(found, 15)).first()
            if s["points"]:
                print(f"Total {s['total']}, peak {s['peak']} ({s['peak_date']:%Y-%m-%d}), average {s['average']:.0f}, {s['points']} points")
    except (QueryError, ValueError) as e:
        say(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
