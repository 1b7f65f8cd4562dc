"""Quality rules whose thresholds come from mergeable quantile sketches.

Per text: words, their code points, symbols, repeated lines and words in
repeated five-word windows. Per (lang, source) a sketch of each ratio: a
histogram with log-linear buckets (exact below 128, at most 1/64 off above), so
that sketches merge by adding counts; tasks add up their own before the
shuffle, and a hot source meets as buckets, not rows.

A group's sketch is merged with PRIOR documents' worth of its language's, and that
with as much of the sketch of all: few documents lean on their parent, many speak for themselves,
and no size switches anything. The limits are read off the merged sketch: some quartile
distances from the median, and never inside the lower TAIL of a hundred.
A document is out if its own count is beyond a limit by NOISE standard deviations
of counting, so that a short text is not judged by one or two symbols or lines. There is no fixed limit. Then documents are
joined with the limits of their group.

The texts are read once; the narrow counts are written and read again for the
sketches and for the join.

Rows: a null text has no words, and fails the base rule; so does an empty one. Long texts are counted whole.
Null lang or source is a group of its own. Repeated rows count each time, a
null doc_id is kept. Other columns are not read by ``judge``, and kept by ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, words

SYMBOLS = r"[#*$%&|<>]"
RUN = 5
#: Leading binary digits of a sketch's buckets.
DIGITS = 7
#: Documents' worth of the parent's sketch that a group's is merged with.
PRIOR = 50
#: Quartile distances from the median to a limit, and the share of a group, in parts of a hundred, that is never beyond it.
FENCE = 6
TAIL = 90
#: Standard deviations of counting by which a document has to be beyond a limit.
NOISE = 3.0
#: Ratios: scale, and the counts divided.
RATIOS = {"symbol_rate": (1000, "n_symbols", "n_words"), "dup_line_rate": (1000, "n_dup_lines", "n_lines"), "word_length": (100, "word_chars", "n_words")}
#: Ratios of which small values are bad too.
TWO_SIDED = ("word_length",)


def run_hashes(w: Column) -> Column:
    """Hashes of the windows of RUN words."""
    n = F.size(w)
    return F.when(n >= RUN, F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(RUN)]))).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", own: Column | None = None) -> DataFrame:
    """doc_id, lang, source and the counts of each text; and ``own``, if given."""
    keys = ["doc_id", "lang", "source"] + ["own"] * (own is not None)
    t = F.coalesce(F.col("_t"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).cast("string").alias("_t"), *([own.alias("own")] if own is not None else []))
    df = df.select(*keys, words(F.col("_t")).alias("_w"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WITH_WORD)).alias("_l"))
    df = df.select(
        *keys, "n_symbols", run_hashes(F.col("_w")).alias("_g"),
        F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    # where a text has repeated windows: sorts them with their places, and adds up what they cover
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k, by: F.coalesce(F.get(F.col("_s"), k + by)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))
    df = df.withColumn("_p", at)
    cover = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(RUN), F.coalesce(F.get(F.col("_p"), k + 1), x + RUN) - x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long")))
    return df.select(*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


#: A line with a word in it.
WITH_WORD = r"[^\x20\x09-\x0D]"


def rates(df: DataFrame) -> DataFrame:
    """The ratios, as whole numbers; null where there is nothing to divide by."""
    for name, (scale, a, b) in RATIOS.items():
        df = df.withColumn(name, F.when(F.col(b) > 0, F.expr(f"({scale} * {a}) div {b}")))
    return df


def dropped(x: Column) -> Column:
    """Binary digits that a value's bucket leaves out."""
    return F.greatest(F.length(F.bin(x)) - DIGITS, F.lit(0))


def bucket(x: Column) -> Column:
    """Lower bound of a value's bucket: its leading binary digits."""
    return F.when(x.isNotNull(), F.call_function("shiftleft", F.call_function("shiftright", x, dropped(x)), dropped(x)))


def limits(df: DataFrame) -> DataFrame:
    """Per (lang, source): low and high of each ratio."""
    names = list(RATIOS)
    long = df.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), F.col(n).alias("x")) for n in names])).alias("r")).select("lang", "source", "r.rate", bucket(F.col("r.x")).alias("x")).where("x is not null")
    sketch = materialize(long.groupBy("lang", "source", "rate", "x").agg(F.count(F.lit(1)).cast("decimal(12,0)").alias("n2")), "sketch")
    whole = F.sum("n").cast("decimal(12,0)")
    mid = sketch.withColumnRenamed("n2", "n").groupBy(F.col("lang").alias("l1"), F.col("rate").alias("r1"), F.col("x").alias("x1")).agg(whole.alias("n1"))
    top = sketch.withColumnRenamed("n2", "n").groupBy(F.col("rate").alias("r0"), F.col("x").alias("x0")).agg(whole.alias("n0"))
    # every group meets every bucket that occurs at all; there are at most some 10,000 of these, as values have 63 binary digits
    groups = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s")).distinct()
    grid = groups.withColumn("rate", F.explode(F.array(*map(F.lit, names)))).join(F.broadcast(top), F.col("rate") == F.col("r0")).select("l", "s", "rate", F.col("x0").alias("x"), "n0")
    grid = grid.join(mid, F.col("l").eqNullSafe(F.col("l1")) & (grid["rate"] == F.col("r1")) & (grid["x"] == F.col("x1")), "left").select("l", "s", grid["rate"], grid["x"], "n0", "n1")
    own = sketch.select(F.col("lang").alias("l2"), F.col("source").alias("s2"), F.col("rate").alias("r2"), F.col("x").alias("x2"), "n2")
    grid = grid.join(own, F.col("l").eqNullSafe(F.col("l2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("rate") == F.col("r2")) & (F.col("x") == F.col("x2")), "left")
    zero = F.lit(0).cast("decimal(12,0)")
    grid = grid.select("l", "s", "rate", "x", "n0", F.coalesce("n1", zero).alias("n1"), F.coalesce("n2", zero).alias("n2"))
    every = Window.partitionBy("l", "s", "rate")
    total = lambda n: F.sum(n).over(every).cast("decimal(12,0)")
    prior = F.lit(PRIOR).cast("decimal(4,0)")
    # n2 + PRIOR * (n1 + PRIOR * n0 / t0) / (t1 + PRIOR), without fractions
    weight = (F.col("n2") * F.col("t0") * (F.col("t1") + prior) + prior * (F.col("n1") * F.col("t0") + prior * F.col("n0"))).cast("decimal(38,0)")
    merged = grid.select("*", total("n0").alias("t0"), total("n1").alias("t1")).withColumn("w", weight)
    ranked = merged.select("l", "s", "rate", "x", F.sum("w").over(every.orderBy("x")).cast("decimal(38,0)").alias("c"), F.sum("w").over(every).cast("decimal(38,0)").alias("t"))
    reached = lambda k: F.min(F.when(100 * F.col("c") >= k * F.col("t"), F.col("x")))
    per = ranked.groupBy("l", "s", "rate").agg(reached(25).alias("q1"), reached(50).alias("q2"), reached(75).alias("q3"), reached(TAIL).alias("tail"))
    last = lambda x: F.col(x) + F.call_function("shiftleft", F.lit(1).cast("long"), dropped(F.col(x))) - 1
    reach = FENCE * (F.col("q3") - F.col("q1"))
    per = per.select(F.col("l").alias("lang"), F.col("s").alias("source"), "rate", F.greatest(last("tail"), last("q2") + reach).alias("high"), (F.col("q2") - reach).alias("low"))
    one = lambda n, f: F.max(F.when(F.col("rate") == n, F.col(f))).alias(f"{f}_{n}")
    return per.groupBy("lang", "source").agg(*[one(n, f) for n in names for f in ("high", "low")])


def verdict(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with counts, joined with the limits of its groups: adds base_failed, failed_rate (the first ratio out of its limits) and kept."""
    df = join_small(rates(df), groups, ["lang", "source"], F.struct("doc_id", "n_words"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def bad(name: str) -> Column:
        scale, a, b = RATIOS[name]
        noise = F.lit(NOISE) * F.sqrt(F.col(a))
        out = scale * (F.col(a) - noise) > F.col(f"high_{name}") * F.col(b)
        if name in TWO_SIDED:
            out = out | (scale * (F.col(a) + noise) < F.col(f"low_{name}") * F.col(b))
        return F.when((F.col(b) > 0) & out, F.lit(name))

    df = df.withColumn("base_failed", base).withColumn("failed_rate", F.coalesce(*map(bad, RATIOS)))
    kept = ~F.col("base_failed") & F.col("failed_rate").isNull()
    return df.withColumn("kept", kept).drop(*[f"{f}_{n}" for n in RATIOS for f in ("high", "low")])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, the counts, the ratios, base_failed, kept and, for the rejected, failed_rate."""
    df = materialize(counts(docs, id_col=id_col, text_col=text_col), "counts")
    return verdict(df, materialize(limits(rates(df)), "limits"))


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. The texts are counted again beside their rows, instead of being shuffled to meet a verdict."""
    narrow = materialize(counts(docs, id_col=id_col, text_col=text_col), "counts")
    groups = materialize(limits(rates(narrow)), "limits")
    # a row number keeps the filter above the counts, which it would otherwise take apart and repeat
    rows = counts(docs, id_col=id_col, text_col=text_col, own=F.struct(*docs.columns)).withColumn("_row", F.monotonically_increasing_id())
    return verdict(rows, groups).where(F.col("kept") & (F.col("_row") >= 0)).select("own.*")
