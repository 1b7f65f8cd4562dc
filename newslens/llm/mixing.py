"""Mixing of sources to target weights by a splitting tree over block quotas.

1. Sources, by code point and null last, weigh 3, 1, 2, repeating. They share
   150 % of all words by weight; a source stops at twice its size, and the excess
   is shared again by weight (water filling, from prefix sums over sources).
2. A source's stream is its documents in a permuted order (by a hash, dealt into
   4096 buckets so that no task orders a whole source), gone through up to twice.
   The mix takes the first ``target`` words of the stream, cut into blocks.
3. The sources' block quotas are split among output shards by a binary tree: at
   each node the blocks are permuted by a hash and the left child gets an exact
   half, so its counts are a multivariate-hypergeometric draw. A shard's blocks of
   a source follow those of the shards before it: disjoint, and none is left out.
4. Within a shard, pieces carry a permuted place. ``mixed`` gives the rows of the
   mix by shard, in that order within each part of a shard that a task orders.

Everything is DataFrame operations, and depends on doc_id, source and size only:
reruns agree. Blocks are counted by the mix, not by the data, so the tree stays
as small at any size, and a cut between blocks may run through a document.

Rows: a null text or one without words has size 0 and no piece. A null source
is a source of its own. Rows with one doc_id are told apart by size, and by
nothing else where these agree too (then each is taken alike or in turn). A
null doc_id is ordered as an empty one. A very long text is cut between blocks and shards as any other.
Other columns, whatever their names, are not read by ``mix`` and kept by ``mixed``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, n_words, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Output shards, a power of two, and blocks of each.
SHARDS = 16
BLOCKS = 64
#: Words of a slot, about: what a task of the mix orders.
SLOT_WORDS = 4_000_000
SEED = "mix-1"


def place(*parts: Column) -> Column:
    """A fixed random place, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, target) from (source, size). One row per source is all that meets in one task."""
    src = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = src.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    everything = Window.partitionBy()
    # the source that its weight fills first comes first
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("cap", REPEATS * F.col("source_size").cast("double"))
        .withColumn("per_weight", (SHARE * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("per_weight"))
    )
    # the first that isn't filled has what all the others get by weight
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("per_weight").alias("v")))).over(everything)["v"]
    share = F.col("weight") * level
    target = F.when(level.isNull() | (F.col("cap") <= share), F.col("cap")).otherwise(share)
    return filled.select("source", "source_size", "rank", target.alias("target"))


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, ends) from (rank, blocks): how many blocks of a source the shards up to each get."""
    level = quotas.select(F.lit(1).alias("node"), "rank", F.col("blocks").cast("long").alias("n"))
    while shards > 1:
        urn = level.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        drawn = urn.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy(place(F.col("node"), F.col("rank"), F.col("k")), "rank", "k")))
        half = F.floor((F.count(F.lit(1)).over(Window.partitionBy("node")) + 1) / 2)
        left = drawn.withColumn("left", (F.col("turn") <= half).cast("long")).groupBy("node", "rank").agg(F.sum("left").alias("l"), F.count(F.lit(1)).alias("n"))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("l")).alias("n"))))
        level = left.select("rank", child.alias("c")).select("rank", F.col("c.node").alias("node"), F.col("c.n").alias("n")).where("n > 0")
        shards //= 2
    by_node = level.groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("m"))
    return by_node


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), *more)


def plan_of(sizes: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(source, source_size, target, take, width, ends): words to take, of a block, and how many blocks of the source the shards up to each get."""
    goal = materialize(targets(sizes).withColumn("take", F.round("target").cast("long")), "targets")
    width = F.greatest(F.lit(1), F.ceil(F.sum("take").over(Window.partitionBy()) / (shards * blocks))).cast("long")
    goal = goal.withColumn("width", width).withColumn("blocks", F.ceil(F.col("take") / F.col("width")).cast("long"))
    shares = split(goal.where("blocks > 0").select("rank", "blocks"), shards)
    leaves = F.sequence(F.lit(shards), F.lit(2 * shards - 1))
    counts = F.transform(leaves, lambda j: F.coalesce(F.element_at("m", j), F.lit(0)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("counts", 1, j), F.lit(0).cast("long"), lambda a, b: a + b))
    return materialize(goal.join(shares, "rank", "left").withColumn("counts", counts).withColumn("ends", ends).select("source", "source_size", "target", "take", "width", "ends"), "plan")


def dealt(df: DataFrame) -> DataFrame:
    """With the place of a document in its source's stream, and its bucket."""
    return df.withColumn("h", place(F.col("doc_id"))).withColumn("bucket", F.substring("h", 1, 3))


def buckets_of(sizes: DataFrame) -> DataFrame:
    """(source, bucket, bucket_size, ahead): words of a bucket, and of those before it in the stream."""
    buckets = dealt(sizes).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).cast("long"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, pieces.

    ``pieces``: array of (shard, block, turn, start, length, place): words ``start``
    to ``start + length`` of the text on turn 0 or 1, in a block, for a shard, there
    in the order of ``place``.
    """
    sizes = materialize(sizes_of(docs, id_col, text_col, source_col), "sizes")
    plan = plan_of(sizes, shards, blocks)
    buckets = buckets_of(sizes).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "ahead")
    within = Window.partitionBy("source", "bucket").orderBy("h", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(sizes).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long"))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("at", F.col("ahead") + F.col("inside")).drop("b_source", "b_bucket", "bucket", "ahead", "inside")
    known = join_small(placed, plan, ["source"], F.col("h"))

    def turn(e: int) -> Column:
        began = F.col("at") + e * F.col("source_size")
        length = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("take") - began))

        def piece(b: Column) -> Column:
            begin = F.greatest(began, b * F.col("width"))
            end = F.least(began + length, (b + 1) * F.col("width"))
            return F.struct(
                F.size(F.filter("ends", lambda x: x <= b)).alias("shard"), b.alias("block"), F.lit(e).alias("turn"), (begin - began).alias("start"), (end - begin).alias("length"),
                place(F.col("h"), b, F.lit(e)).alias("place"),
            )

        first, last = F.floor(began / F.col("width")).cast("long"), F.floor((began + length - 1) / F.col("width")).cast("long")
        none = F.array().cast("array<struct<shard:int,block:bigint,turn:int,start:bigint,length:bigint,place:string>>")
        return F.when(length > 0, F.transform(F.sequence(first, last), piece)).otherwise(none)

    known = known.withColumn("pieces", F.concat(*[turn(e) for e in range(REPEATS)]))
    return known.select("doc_id", "source", "size", "source_size", "target", "pieces")


def taken(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["length"])


def digest(pieces: Column) -> Column:
    """The pieces in words: shard:block:turn:start:length, by turn and block, joined by commas."""
    return F.array_join(F.transform(pieces, lambda p: F.concat_ws(":", *[p[f].cast("string") for f in ("shard", "block", "turn", "start", "length")])), ",")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", shards: int = SHARDS, blocks: int = BLOCKS, cut: bool = False) -> DataFrame:
    """The mix itself: rows of ``docs`` with the words taken, in the order of the mix.

    A row is what a document gives on a turn; with ``cut`` what it gives to a shard on
    a turn, so that shards get their blocks exactly. Without, a document that a
    border of shards runs through is whole in the shard where it begins. Tasks hold slots: a
    shard's share of the buckets, chosen by a hash, within which rows are in the order of ``place``.

    A bucket's words, and so the shards that it may meet, are known before texts move:
    texts go to those shards at once, with one row that tells the words ahead of
    the bucket, and a document's place is found there.
    """
    sizes = materialize(sizes_of(docs, id_col, text_col, source_col), "sizes")
    plan = plan_of(sizes, shards, blocks)
    total = plan.agg(F.sum("take")).first()[0] or 0
    share = max(1, -(-total // (shards * SLOT_WORDS)))
    # what a shard takes of a source's stream, in words from the begin of the first turn
    turns = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("turn")
    takes = plan.where("take > 0").select("source", "source_size", "take", "width", F.posexplode("ends").alias("shard", "end"), F.concat(F.array(F.lit(0).cast("long")), "ends").alias("begins"))
    takes = takes.select("source", "source_size", "take", "width", "shard", (F.element_at("begins", F.col("shard") + 1) * F.col("width")).alias("lo"), F.least(F.col("end") * F.col("width"), "take").alias("hi")).where("lo < hi")
    takes = materialize(takes.select("*", turns).where("lo < (turn + 1) * source_size and hi > turn * source_size"), "takes")
    slot = (F.col("shard") * share + F.pmod(F.xxhash64("source", "bucket", "turn"), F.lit(share))).alias("slot")
    of = takes.select(F.col("source").alias("t_source"), "turn", "shard", "lo", "hi", "source_size", "width", "take")
    buckets = buckets_of(sizes).where("bucket_size > 0")
    heads = buckets.join(of, F.col("source").eqNullSafe(F.col("t_source")) & F.expr("ahead + turn * source_size < hi and ahead + bucket_size + turn * source_size > lo"))
    heads = materialize(heads.select(slot, "turn", "shard", "source", "bucket", F.col("ahead").alias("size"), "lo", "hi", "source_size", "width", "take"), "heads")
    ranges = heads.groupBy("source", "turn", "shard", "lo", "hi", "source_size", "width", "take").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    ranges = materialize(ranges.groupBy("source").agg(F.collect_list(F.struct("turn", "shard", "lo", "hi", "source_size", "width", "take", "first", "last")).alias("ranges")), "ranges")

    own = F.struct(*docs.columns).alias("own")
    rows = join_small(dealt(sizes_of(docs, id_col, text_col, source_col, own).where("size > 0")), ranges, ["source"], F.col("h"))
    rows = rows.withColumn("r", F.explode(F.filter("ranges", lambda r: (r["first"] <= F.col("bucket")) & (F.col("bucket") <= r["last"]))))
    names = ["turn", "shard", "lo", "hi", "source_size", "width", "take"]
    rows = rows.select("doc_id", "source", "size", "own", "h", "bucket", *[F.col(f"r.{c}").alias(c) for c in names]).withColumn("slot", slot)
    # rows of one doc_id and size come in the same order for each shard and turn
    rows = rows.withColumn("tie", F.xxhash64("own"))
    rows = rows.unionByName(heads, allowMissingColumns=True).repartition(shards * share, "slot")
    before = Window.partitionBy("slot", "source", "turn", "bucket", "shard").orderBy(F.asc_nulls_first("h"), F.asc_nulls_first("doc_id"), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("began", F.sum("size").over(before) + F.col("turn") * F.col("source_size")).where("h is not null")
    stop = F.least(F.col("began") + F.col("size"), F.col("take"), (F.col("turn") + 1) * F.col("source_size"))
    begin = F.greatest("began", "lo")
    rows = rows.withColumn("start", begin - F.col("began")).withColumn("length", F.least(stop, "hi") - begin).where("length > 0")
    if not cut:
        rows = rows.where("start = 0").withColumn("length", stop - F.col("began"))
    rows = rows.withColumn("place", place(F.col("h"), F.floor((F.col("began") + F.col("start")) / F.col("width")).cast("long"), F.col("turn"))).sortWithinPartitions("slot", "place", "doc_id", "size", "tie")
    # few texts are cut: where the mix or, with cut, a shard ends
    part = F.array_join(F.slice(words(F.col(f"own.`{text_col}`")), (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ")
    text = F.when(F.col("length") >= F.col("size"), F.col(f"own.`{text_col}`")).otherwise(part)
    out = rows.select(*[text.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
