"""Queries over documents and pages: text, metadata, images, sentences, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions import scalars, text, times
from newslens.operators import articles, context, tags
from newslens.sources import sinks, views
from newslens.sources.tables import table

from .query import View, matches

NORM = r"' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"
DOCS = f"WITH d AS (SELECT doc_id, lang, source, n_chars, text, {NORM} AS norm FROM documents)"


def search(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.documents(spark, sf_dir).where(matches(query, views.documents_view())).select("doc_id", "lang", "source")

    return run


def found(condition: str) -> str:
    return f"{DOCS} SELECT doc_id, lang, source FROM d WHERE {condition}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents that match."""
    rows = views.documents(spark, sf_dir).where(matches('"of the" (that OR was) -for', views.documents_view()))
    return rows.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(articles.CLIENT_DEFAULT)


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    rows = articles.hybrid(docs.where(matches("of that", views.documents_view())), docs, "source", ["of", "that"])
    return rows.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(25)


def page_search(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.pages(spark, sf_dir).where(matches(query, views.pages_view())).select("page_id", "host")

    return run


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"


def found_pages(condition: str) -> str:
    return f"WITH p AS (SELECT page_id, {HOST} AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages) SELECT page_id, host FROM p WHERE {condition}"


def image_cloud(field: str):
    return lambda spark, sf_dir: tags.cloud(views.pages(spark, sf_dir), matches("imagenumfaces>1", views.pages_view()), field, 5)


def sentences(query: str, quotes: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return context.search(docs, query, View(F.col("norm")), quotes).select("doc_id", "sent_idx", "snippet")

    return run


def found_sentences(condition: str) -> str:
    return rf"""
WITH s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+\s+') AS a FROM documents),
e AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, a[i] AS sentence FROM s, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS norm FROM e WHERE trim(sentence) <> '')
SELECT doc_id, sent_idx, CASE WHEN length(sentence) > 200 THEN left(sentence, 200) || '...' ELSE sentence END AS snippet FROM n WHERE {condition}"""


def near_sql(a: str, b: str, n: int) -> str:
    return rf"""{DOCS},
w AS (SELECT doc_id, i, a[i] AS w FROM (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS a FROM d), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
m AS (SELECT DISTINCT x.doc_id FROM w x JOIN w y ON x.doc_id = y.doc_id AND abs(x.i - y.i) <= {n} WHERE x.w = '{a}' AND y.w = '{b}')
SELECT doc_id, lang, source FROM d WHERE doc_id IN (SELECT doc_id FROM m)"""


def near_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity by a join of word places, instead of a pattern."""
    both = views.documents(spark, sf_dir).where(matches("of that", views.documents_view()))
    place = lambda w: F.explode(text.places(F.col("norm"), w)).alias("i")
    x = both.select("doc_id", "lang", "source", place("of")).alias("x")
    y = both.select("doc_id", place("that")).alias("y")
    near = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.abs(F.col("x.i") - F.col("y.i")) <= 3)
    return x.join(y, near, "left_semi").select("doc_id", "lang", "source").distinct()


def source_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .query import country

    n = table(spark, sf_dir, "nation")
    view = View(None, {"sourcecountry": country(F.col("n_name"), F.lpad((F.col("n_nationkey") % 10).cast("string"), 2, "0"))})
    return n.where(matches("(sourcecountry:nation_3 OR sourcecountry:03)", view)).select("n_nationkey", "n_name")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.documents(spark, sf_dir).select("doc_id", text.occurrences(F.col("norm"), "the").alias("n_the"), F.size(text.tokens(F.col("norm"))).cast("bigint").alias("n_tokens"))


def as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the fields of an article; the date is synthetic."""
    p = views.pages(spark, sf_dir)
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") % 9000).cast("int"))
    return p.select("page_id", "url", "title", at.alias("seendate"), F.col("host").alias("domain"), F.lit("English").alias("language"), F.when(F.col("page_id") % 3 == 0, "France").alias("sourcecountry"))


ARTICLES = f"""WITH p AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, TIMESTAMP '2024-01-01' + to_minutes(page_id % 9000) AS seendate, {HOST} AS domain,
'English' AS language, CASE WHEN page_id % 3 = 0 THEN 'France' END AS sourcecountry FROM pages)"""


def csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_row(as_articles(spark, sf_dir))


def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.article_row(as_articles(spark, sf_dir))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_articles(spark, sf_dir)
    item = F.from_json(sinks.feed_item(rows), "id string, url string, title string, date_published string")
    return rows.select("page_id", item.alias("i")).select("page_id", "i.id", "i.url", "i.title", "i.date_published")


def jsonp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_articles(spark, sf_dir).select("page_id", "domain")
    return rows.select("page_id", sinks.jsonp(F.to_json(F.struct("domain")), "show").alias("payload"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        "n_nationkey", scalars.country_key(F.col("n_name")).alias("country_key"), scalars.shorten(F.col("n_name"), 5).alias("short"), scalars.tone_label((k - 12).cast("double")).alias("label"),
        scalars.whole(F.concat((k - 5).cast("string"), F.lit(".9"))).alias("whole"), F.coalesce(scalars.whole(F.lit("n/a")), F.lit(-1)).cast("bigint").alias("bad"), scalars.rounded(k / F.lit(2.0)).alias("half_even"),
        F.size(scalars.split_list(F.concat(F.lit(" a,, "), F.col("n_name"), F.lit(" ,")))).cast("bigint").alias("items"), scalars.first_of(F.lit(""), F.lit(None).cast("string"), F.col("n_name")).alias("first"),
        times.day_of_stamp(F.lit("20260224T163000Z")).alias("day"), times.minute(times.parse_stamp(F.lit("20260224T163000Z"))).alias("minute"), times.parse_stamp(F.lit("2026-02-24")).isNull().alias("bad_stamp"),
        times.minute(times.fortnight(F.to_timestamp_ntz(F.lit("2026-02-24 16:30:00")))).alias("fortnight"), scalars.signed(k - F.lit(1.5)).alias("signed"),
    )


SCALARS = """SELECT n_nationkey, lower(replace(n_name, ' ', '')) AS country_key, CASE WHEN length(n_name) > 5 THEN left(n_name, 5) || '...' ELSE n_name END AS short,
CASE WHEN n_nationkey - 12 > 2 THEN 'POSITIVE' WHEN n_nationkey - 12 > 0 THEN 'SLIGHTLY POSITIVE' WHEN n_nationkey - 12 > -2 THEN 'SLIGHTLY NEGATIVE' ELSE 'NEGATIVE' END AS label,
CAST(trunc(CAST(CAST(n_nationkey - 5 AS VARCHAR) || '.9' AS DOUBLE)) AS BIGINT) AS whole, CAST(-1 AS BIGINT) AS bad, round_even(n_nationkey / 2.0, 0)::DOUBLE AS half_even,
CAST(2 AS BIGINT) AS items, n_name AS first, '2026-02-24' AS day, '2026-02-24 16:30' AS minute, TRUE AS bad_stamp, '2026-02-15 00:00' AS fortnight, printf('%+.2f', n_nationkey - 1.5::DOUBLE) AS signed FROM nation"""

_REPEAT = "(length(replace(norm, ' ', '  ')) - length(replace(replace(norm, ' ', '  '), ' {t} ', ''))) // {n} >= {k}"

QUERIES = {
    "flagship": (flagship, f"{DOCS} SELECT doc_id, lang, source, n_chars FROM d WHERE contains(norm, ' of the ') AND (contains(norm, ' that ') OR contains(norm, ' was ')) AND NOT contains(norm, ' for ') ORDER BY n_chars DESC, doc_id LIMIT 25"),
    "kw_and": (search("of that"), found("contains(norm, ' of ') AND contains(norm, ' that ')")),
    "kw_explicit_and": (search("of AND that"), found("contains(norm, ' of ') AND contains(norm, ' that ')")),
    "phrase": (search('"of the"'), found("contains(norm, ' of the ')")),
    "or_group": (search('(was OR "of the")'), found("contains(norm, ' was ') OR contains(norm, ' of the ')")),
    "exclude": (search("the -for"), found("contains(norm, ' the ') AND NOT contains(norm, ' for ')")),
    "exclude_not": (search("the NOT (for OR was)"), found("contains(norm, ' the ') AND NOT (contains(norm, ' for ') OR contains(norm, ' was '))")),
    "near_n": (search('near3:"of that"'), near_sql("of", "that", 3)),
    "near_postings": (near_postings, near_sql("of", "that", 3)),
    "repeat_n": (search('repeat5:"the"'), found(_REPEAT.format(t="the", n=5, k=5))),
    "repeat_phrase": (search('repeat2:"of the"'), found(_REPEAT.format(t="of  the", n=9, k=2))),
    "term_stats": (term_stats, rf"{DOCS} SELECT doc_id, CAST((length(replace(norm, ' ', '  ')) - length(replace(replace(norm, ' ', '  '), ' the ', ''))) // 5 AS BIGINT) AS n_the, CAST(len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM d"),
    "place_group": (search('the ("of the" OR "in the")'), found("contains(norm, ' the ') AND (contains(norm, ' of the ') OR contains(norm, ' in the '))")),
    "lang_filter": (search("sourcelang:fr"), found("lang = 'fr'")),
    "theme_filter": (search("theme:LANG_DE"), found("lang = 'de'")),
    "mixed_or": (search("(theme:src1 OR sourcelang:es) -the"), found("(source = 'src1' OR lang = 'es') AND NOT contains(norm, ' the ')")),
    "source_country": (source_country, "SELECT n_nationkey, n_name FROM nation WHERE lower(replace(n_name, ' ', '')) = 'nation_3' OR n_nationkey % 10 = 3"),
    "relevance": (relevance, rf"{DOCS}, v AS (SELECT source, count(*) AS volume FROM d GROUP BY source), s AS (SELECT doc_id, source, (((length(replace(norm, ' ', '  ')) - length(replace(replace(norm, ' ', '  '), ' of ', ''))) // 4) + ((length(replace(norm, ' ', '  ')) - length(replace(replace(norm, ' ', '  '), ' that ', ''))) // 6)) AS tf, len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS n FROM d WHERE contains(norm, ' of ') AND contains(norm, ' that ')) SELECT doc_id, round(tf / ln(2.718281828459045::DOUBLE + n) + 0.1::DOUBLE * ln(1 + volume::DOUBLE), 6) AS score FROM s JOIN v USING (source) ORDER BY score DESC, doc_id LIMIT 25"),
    "domain_suffix": (page_search("domain:example.com"), found_pages("host = 'example.com' OR host LIKE '%.example.com'")),
    "domain_exact": (page_search("domainis:www.example.com"), found_pages("host = 'www.example.com'")),
    "image_tags": (page_search('imagetag:"tag3"'), found_pages("page_id % 7 = 3")),
    "image_webtags": (page_search('imagewebtag:"web2"'), found_pages("page_id % 5 = 2")),
    "image_ocr": (page_search('imageocrmeta:"caption no 4"'), found_pages("page_id % 9 = 4")),
    "image_numeric": (page_search("imagefacetone<0 imagenumfaces>1 imagewebcount<50"), found_pages("page_id % 5 < 2 AND page_id % 4 > 1 AND page_id * 13 % 100 < 50")),
    "image_cloud": (image_cloud("tags"), "SELECT tag, count(*) AS n FROM (SELECT unnest(['tag' || (page_id % 7), 'kind' || (page_id % 3)]) AS tag FROM pages WHERE page_id % 4 > 1) GROUP BY tag ORDER BY n DESC, tag LIMIT 5"),
    "image_webcloud": (image_cloud("webtags"), "SELECT 'web' || (page_id % 5) AS tag, count(*) AS n FROM pages WHERE page_id % 4 > 1 GROUP BY 1 ORDER BY n DESC, tag LIMIT 5"),
    "image_gallery": (lambda spark, d: views.pages(spark, d).select("page_id", F.explode("images").alias("i")).select("page_id", "i.ocrmeta", "i.webcount"), "SELECT page_id, 'Caption No. ' || (page_id % 9) AS ocrmeta, page_id * 13 % 100 AS webcount FROM pages"),
    "theme_pairs": (lambda spark, d: tags.together(views.documents(spark, d), "themes"), "SELECT 'LANG_' || upper(lang) AS theme, source AS other, count(*) AS n FROM documents GROUP BY ALL"),
    "sentence_search": (sentences("the of", False), found_sentences("contains(norm, ' the ') AND contains(norm, ' of ')")),
    "sentence_quotes": (sentences("(the OR de OR der OR la OR api OR key OR of)", True), found_sentences("""regexp_matches(sentence, '"[^"]+"') AND regexp_matches(norm, ' (the|de|der|la|api|key|of) ')""")),
    "article_list": (article_list, f"{ARTICLES} SELECT url, '' AS url_mobile, title, strftime(seendate, '%Y%m%dT%H%M%SZ') AS seendate, '' AS socialimage, domain, language, coalesce(sourcecountry, '') AS sourcecountry FROM p"),
    "csv_shape": (csv_shape, f"{ARTICLES} SELECT strftime(seendate, '%Y-%m-%d %H:%M') AS \"Date\", title AS \"Title\", domain AS \"Source\", coalesce(sourcecountry, '') AS \"SourceCountry\", language AS \"Language\", url AS \"URL\" FROM p"),
    "jsonfeed": (feed, f"{ARTICLES} SELECT page_id, url AS id, url, title, strftime(seendate, '%Y-%m-%dT%H:%M:%SZ') AS date_published FROM p"),
    "jsonp": (jsonp, f"{ARTICLES} SELECT page_id, 'show({{\"domain\":\"' || domain || '\"}})' AS payload FROM p"),
    "scalar_functions": (scalar_functions, SCALARS),
}
