"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, maxscore, mixing, packing, pii, pu_quality, quality_rules, suffix_dedup, token_groups, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_read(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_groups.join(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), mixing.digest(F.col("pieces")).alias("pieces"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return maxscore.top_k(rows.where("vec_id % 50 = 0"), rows, k=5)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = pu_quality.classify(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP7_SQL = """
WITH e AS (SELECT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM e),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""



def _tree_sql(levels: int = 4, blocks: int = 64) -> str:
    """The splitting tree, one level after another: blocks of a source that each shard gets (n), and where they end (stop)."""
    steps = [f"wide AS (SELECT greatest(1, ceil(sum(round(target)) / {blocks << levels}))::BIGINT AS width FROM goal)", "n0 AS (SELECT 1 AS node, rnk, ceil(round(target) / width)::BIGINT AS n FROM goal, wide)"]
    for k in range(levels):
        steps.append(f"u{k} AS (SELECT node, rnk, unnest(range(1, n + 1)) AS k FROM n{k} WHERE n > 0)")
        steps.append(f"d{k} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('mix-1:' || node || ':' || rnk || ':' || k), rnk, k) AS turn, count(*) OVER (PARTITION BY node) AS c FROM u{k})")
        steps.append(f"l{k} AS (SELECT node, rnk, count(*) FILTER (turn <= (c + 1) // 2) AS l, count(*) AS n FROM d{k} GROUP BY node, rnk)")
        steps.append(f"n{k + 1} AS (SELECT 2 * node AS node, rnk, l AS n FROM l{k} WHERE l > 0 UNION ALL SELECT 2 * node + 1, rnk, n - l FROM l{k} WHERE n > l)")
    return ",\n".join(steps) + f",\nleaf AS (SELECT node - {1 << levels} AS shard, rnk, n, sum(n) OVER (PARTITION BY rnk ORDER BY node) AS stop FROM n{levels})"


OP5_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM src),
weighed AS (SELECT *, CAST([3, 1, 2][(rnk - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * CAST(source_size AS DOUBLE) AS cap FROM ranked),
lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS per_weight
        FROM weighed WINDOW b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill AS (SELECT arg_min(per_weight, cap / weight) AS level FROM lev WHERE cap > weight * per_weight),
goal AS (SELECT source, source_size, rnk, CASE WHEN level IS NULL OR cap <= weight * level THEN cap ELSE weight * level END AS target FROM lev, fill),
placed AS (SELECT sizes.*, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM sizes),
pos AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM placed),
{tree},
spot AS (SELECT pos.doc_id, pos.size, goal.source_size, goal.target, goal.rnk, wide.width, pos.a + e * goal.source_size AS began, e, round(goal.target)::BIGINT AS take
       FROM pos JOIN goal ON pos.source IS NOT DISTINCT FROM goal.source CROSS JOIN wide CROSS JOIN (VALUES (0), (1)) t(e)),
lengths AS (SELECT *, greatest(0, least(size, take - began))::BIGINT AS length FROM spot),
cut AS (SELECT *, unnest(range(CAST(began // width AS BIGINT), CAST((began + length - 1) // width + 1 AS BIGINT))) AS b FROM lengths WHERE length > 0),
piece AS (SELECT cut.doc_id, shard || ':' || b || ':' || e || ':' || (greatest(began, b * width) - began)::BIGINT || ':' || (least(began + length, (b + 1) * width) - greatest(began, b * width))::BIGINT AS piece, e, b
          FROM cut JOIN leaf ON leaf.rnk = cut.rnk AND b >= leaf.stop - leaf.n AND b < leaf.stop),
listed AS (SELECT doc_id, string_agg(piece, ',' ORDER BY e, b) AS pieces FROM piece GROUP BY doc_id)
SELECT lengths.doc_id, size, source_size, target, sum(length)::BIGINT AS taken, coalesce(any_value(pieces), '') AS pieces
FROM lengths LEFT JOIN listed ON listed.doc_id IS NOT DISTINCT FROM lengths.doc_id GROUP BY lengths.doc_id, size, source_size, target
"""

OP2_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
k AS (SELECT *, CASE WHEN n_words > 0 THEN (1000 * n_symbols) // n_words END AS symbol_rate,
             CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines) // n_lines END AS dup_line_rate,
             CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words END AS word_length FROM c),
x AS (SELECT lang, source, rate, (v >> s) << s AS x, s, count(*) AS n
      FROM (SELECT lang, source, rate, v, greatest(length(bin(v)) - 7, 0) AS s FROM
            (SELECT lang, source, 'symbol_rate' AS rate, symbol_rate AS v FROM k UNION ALL SELECT lang, source, 'dup_line_rate', dup_line_rate FROM k
             UNION ALL SELECT lang, source, 'word_length', word_length FROM k) WHERE v IS NOT NULL) GROUP BY ALL),
h1 AS (SELECT lang, rate, x, sum(n) AS n FROM x GROUP BY lang, rate, x),
h0 AS (SELECT rate, x, s, sum(n) AS n FROM x GROUP BY rate, x, s),
m AS (SELECT g.lang, g.source, h0.rate, h0.x, h0.s, coalesce(x.n, 0)::HUGEINT AS n2, coalesce(h1.n, 0)::HUGEINT AS n1, h0.n::HUGEINT AS n0,
             sum(coalesce(h1.n, 0)) OVER w AS t1, sum(h0.n) OVER w AS t0
      FROM (SELECT DISTINCT lang, source FROM x) g CROSS JOIN h0
      LEFT JOIN h1 ON h1.lang IS NOT DISTINCT FROM g.lang AND h1.rate = h0.rate AND h1.x = h0.x
      LEFT JOIN x ON x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source AND x.rate = h0.rate AND x.x = h0.x
      WINDOW w AS (PARTITION BY g.lang, g.source, h0.rate)),
q AS (SELECT lang, source, rate, x, x + (1 << s) - 1 AS last, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY x) AS c, sum(w) OVER (PARTITION BY lang, source, rate) AS t
      FROM (SELECT *, n2 * t0 * (t1 + 50) + 50 * (n1 * t0 + 50 * n0) AS w FROM m)),
p AS (SELECT lang, source, rate, min(x) FILTER (100 * c >= 25 * t) AS q1, min(x) FILTER (100 * c >= 50 * t) AS q2, min(last) FILTER (100 * c >= 50 * t) AS q2_last,
             min(x) FILTER (100 * c >= 75 * t) AS q3, min(last) FILTER (100 * c >= 90 * t) AS tail FROM q GROUP BY lang, source, rate),
f AS (SELECT lang, source, rate, greatest(tail, q2_last + 6 * (q3 - q1)) AS high, q2 - 6 * (q3 - q1) AS low FROM p),
o AS (SELECT k.*, f.rate, f.high, f.low FROM k LEFT JOIN f ON f.lang IS NOT DISTINCT FROM k.lang AND f.source IS NOT DISTINCT FROM k.source),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             bool_or(coalesce(CASE rate WHEN 'symbol_rate' THEN n_words > 0 AND 1000 * (n_symbols - 3::DOUBLE * sqrt(n_symbols)) > high * n_words
                                        WHEN 'dup_line_rate' THEN n_lines > 0 AND 1000 * (n_dup_lines - 3::DOUBLE * sqrt(n_dup_lines)) > high * n_lines
                                        ELSE n_words > 0 AND (100 * (word_chars - 3::DOUBLE * sqrt(word_chars)) > high * n_words OR 100 * (word_chars + 3::DOUBLE * sqrt(word_chars)) < low * n_words) END, FALSE)) AS bad
      FROM o GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_spans, op2_quality_rules, op3_license_scan, op4_ngram_jaccard_join, op5_mix_sources, op6_toxicity, op7_maxscore_topk, op8_pack_sequences, op9_suffix_dedup, op10_pu_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op3_license_scan": licenses.oracle(), "op5_mix_sources": OP5_SQL.replace("{tree}", _tree_sql()), "op7_maxscore_topk": OP7_SQL}
