"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A byte goes if a string of LENGTH bytes around it also starts earlier, in the
order of documents and then of starts. Whether a string does is found by sorting
suffixes, in the manner of difference-cover construction:

1. Cover sample. Positions are sampled so that two equal strings of LENGTH
   bytes are sampled at the same distance from their starts. A difference cover
   of residues promises that for any two strings, at a density of one over the
   root of its period; only equal strings matter here, and for them the least
   hash of GRAM bytes within the string (the leftmost, if several) promises the same at
   one position in about 35. The rank of a sample is the class of its GRAM bytes.
2. Buckets. Samples are dealt by rank, and those whose rank occurs once are
   dropped: no string through them repeats. Only the others fetch their context.
3. Sorting. A task sorts one run of buckets at a time: the suffixes that start at
   the samples of a bucket, and the reversed prefixes that end there, each with
   the lengths of common prefixes of neighbours. Two strings through two samples
   are equal if the parts before and after the samples are, so strings tie by
   their sample's rank, and their class is the pair (class of the part before,
   class of the part after). The first of each class stays.

A bucket of more than HOT samples is dealt into shares first. Within a share,
strings met before are repeats; samples with a string that is the first in its
share go on to another round, each for both halves of the strings through it, dealt by
the bytes that all strings of a half have in common. Rounds go on until no bucket
is larger than HOT: a common string is told once by each share, so what is left of it
shrinks by that factor every time. Strings are compared by all their bytes; hashes only say where they meet.

The texts are read three times. Those with repeated samples or repeated strings, which a bitmap
of fixed size tells, are shuffled once to meet the places.

Rows: a null text is empty. Rows that repeat a doc_id are documents of their
own, in the order of their texts; so are rows with a null doc_id, after all
others. Texts shorter than LENGTH bytes keep all. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POWERS, id_bit, id_filter, materialize, passes, tidy, unique_ids

LENGTH = 100
GRAM = 32
#: Bytes of context on either side of a sample.
SIDE = LENGTH - GRAM
#: Samples of one rank that a task sorts together at most, and rows in a run of buckets.
HOT = 4096
RUN = 8192
#: Samples of one rank in a batch that are sent as one row: a frequent rank meets as batches, not as samples.
MANY = 8
#: Starts of strings that are looked at together in one text.
BLOCK = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 23) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    up, down = POWERS.get(len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


def samples(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the cover sample of one text."""
    places, ranks = [], []
    for begin in range(0, len(b) - LENGTH + 1, BLOCK):
        part = b[begin : begin + BLOCK + LENGTH - 1]
        h = gram_hashes(part)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, SIDE + 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        at = (least & _PLACE).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        places.append(at + begin)
        ranks.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, rank = np.concatenate(places), np.concatenate(ranks)
    if len(places) > 1:
        place, first = np.unique(place, return_index=True)
        rank = rank[first]
    return place, rank.view(np.int64)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def _lengths(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of neighbours in ``order``, the bytes that agree from the start; -1 across groups."""
    s, g = rows[order], group[order]
    same = s[1:] == s[:-1]
    n = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    n[g[1:] != g[:-1]] = -1
    return np.concatenate([[-1], n])


def _sorted(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of byte rows within groups."""
    pad = -rows.shape[1] % 8
    words = np.pad(rows, ((0, 0), (0, pad))).copy().view(">u8").astype(np.uint64)
    return np.lexsort([*words.T[::-1], group])


def repeated(group: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, parts: tuple[int, int] = (0, SIDE)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For samples in the order of documents and places: least and greatest part before of a string that occurred earlier in the group (-1: none), and whether any string is a first one.

    ``before`` holds the SIDE bytes before, last byte first. Strings with a part before
    within ``parts``, both ends included, are looked at.
    """
    m = len(group)
    lo, hi = np.full(m, -1), np.full(m, -1)
    fresh = np.zeros(m, dtype=bool)
    orders = [_sorted(x, group) for x in (before, after)]
    common = [_lengths(x, group, o) for x, o in zip((before, after), orders)]
    places = np.arange(m)
    for part in range(parts[0], parts[1] + 1):
        rest = SIDE - part
        valid = (n_before >= part) & (n_after >= rest)
        if not valid.any():
            continue
        key = np.zeros(m, dtype=np.int64)
        for order, n, need in zip(orders, common, (part, rest)):
            cls = np.empty(m, dtype=np.int64)
            cls[order] = np.cumsum(n < need)
            key = key * (m + 1) + cls
        rows = places[valid]
        by = rows[np.argsort(key[rows], kind="stable")]
        again = np.zeros(m, dtype=bool)
        again[by[1:]] = key[by[1:]] == key[by[:-1]]
        lo[again & (lo < 0)] = part
        hi[again] = part
        fresh |= valid & ~again
    return lo, hi, fresh


def groups(bucket: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A number for each bucket and GRAM bytes. Rows come by bucket, and hardly ever do two strings of GRAM bytes share one."""
    change = np.concatenate([[False], bucket[1:] != bucket[:-1]])
    differs = np.concatenate([[False], (gram[1:] != gram[:-1]).any(axis=1)])
    if not (differs & ~change).any():
        return np.cumsum(change)
    return np.unique(np.hstack([np.cumsum(change).astype(">i8")[:, None].view(np.uint8), gram]), axis=0, return_inverse=True)[1].ravel()


WIDTH = 2 * SIDE + GRAM
#: A sample with the bytes around it, and the parts before of the strings that are looked at.
CONTEXT = "rank long, n long, row long, place long, n_before int, n_after int, context binary, least int, most int"
SPANS = "row long, start long, end long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole buckets; the batches are ordered by bucket."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < RUN:
            continue
        whole = pa.Table.from_batches(held)
        bucket = whole.column("bucket").to_numpy()
        cut = int(np.argmax(bucket == bucket[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        size = len(bucket) - cut
    if held:
        yield pa.Table.from_batches(held)


def _sort_buckets(df: DataFrame) -> DataFrame:
    """(row, start, end) of repeated strings, and beside them, as s_*, the samples of shared buckets that go on. ``df``: CONTEXT with bucket and shared."""
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    schema = SPANS + ", " + ", ".join(f"s_{x}" for x in CONTEXT.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            table = table.combine_chunks()
            m = table.num_rows
            col = lambda c: table.column(c).to_numpy()
            context = np.frombuffer(b"".join(table.column("context").to_pylist()), dtype=np.uint8).reshape(m, WIDTH)
            group = groups(col("bucket"), context[:, SIDE : SIDE + GRAM])
            parts = col("least").astype(np.int64) * WIDTH + col("most")
            lo, hi, fresh = np.full(m, -1), np.full(m, -1), np.zeros(m, dtype=bool)
            for p in np.unique(parts):
                at = np.flatnonzero(parts == p)
                before, after = np.ascontiguousarray(context[at, SIDE - 1 :: -1]), np.ascontiguousarray(context[at, SIDE + GRAM :])
                lo[at], hi[at], fresh[at] = repeated(group[at], before, after, col("n_before")[at], col("n_after")[at], divmod(int(p), WIDTH))
            found = np.flatnonzero(lo >= 0)
            row, place = col("row"), col("place")
            spans = pa.table({k: pa.array(v, pa.int64()) for k, v in (("row", row[found]), ("start", place[found] - hi[found]), ("end", place[found] - lo[found] + LENGTH))})
            on = np.flatnonzero(fresh & np.asarray(table.column("shared").to_numpy(zero_copy_only=False), dtype=bool))
            more = table.take(pa.array(on)).select(names)
            yield from _both(spans, more.rename_columns([f"s_{c}" for c in names]))

    return df.mapInArrow(tidy(run), schema)


def _both(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of ``a`` and of ``b`` with nulls in each other's columns."""
    schema = pa.schema([*a.schema, *b.schema])
    for t in (a, b):
        if t.num_rows:
            cols = [t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema]
            yield from pa.Table.from_arrays(cols, schema=schema).combine_chunks().to_batches()


def _samples(docs: DataFrame) -> DataFrame:
    """(rank, row, place, m, more): one row per sample; or, where a batch has MANY of a rank, one row with their number m and all of them in ``more``."""
    schema = "rank long, row long, place long, m long, more array<struct<row:bigint,place:bigint>>"
    pairs = pa.list_(pa.struct([("row", pa.int64()), ("place", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    place, rank = samples(_bytes(text))
                    for c, v in zip(out, (rank, np.full(len(place), row, dtype=np.int64), place)):
                        c.append(v)
            if not out[0]:
                continue
            rank, row, place = map(np.concatenate, out)
            by = np.argsort(rank, kind="stable")
            rank, row, place = rank[by], row[by], place[by]
            starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(rank)))
            often = np.repeat(sizes >= MANY, sizes)
            few = np.flatnonzero(~often)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[few]) for c in (rank, row, place)), pa.array(np.ones(len(few), np.int64)), pa.nulls(len(few), pairs)], names=["rank", "row", "place", "m", "more"])
            many = sizes >= MANY
            if many.any():
                m = sizes[many]
                offsets = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(row[often]), pa.array(place[often])], names=["row", "place"])
                nothing = pa.nulls(len(m), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rank[starts[many]]), nothing, nothing, pa.array(m.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["rank", "row", "place", "m", "more"])

    return docs.select("row", "text").mapInArrow(tidy(run), schema)


def _where(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """Rows whose bit is on. The bitmap goes to the tasks once."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield batch.filter(pa.array(passes(sent.value, batch.column(2).to_numpy()))).select([0, 1])

    return docs.select("row", "text", id_bit("row").alias("bit")).mapInArrow(tidy(run), "row long, text string")


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """CONTEXT of the samples (rank, n, row, place)."""
    lists = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "n"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.arange(-SIDE, GRAM + SIDE)
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                for row, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    b = _bytes(text)
                    fields = at.values.flatten()
                    place, rank, n = (np.asarray(f) for f in fields)
                    padded = np.concatenate([np.zeros(SIDE, np.uint8), b, np.zeros(SIDE, np.uint8)])
                    for begin in range(0, len(place), 4096):
                        p = place[begin : begin + 4096]
                        context = padded[(p[:, None] + SIDE) + near]
                        m = len(p)
                        offsets = pa.py_buffer(np.arange(0, (m + 1) * WIDTH, WIDTH, dtype=np.int32)[: m + 1])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(rank[begin : begin + 4096], pa.int64()), pa.array(n[begin : begin + 4096], pa.int64()), pa.array(np.full(m, row), pa.int64()), pa.array(p, pa.int64()),
                                pa.array(np.minimum(p, SIDE), pa.int32()), pa.array(np.minimum(len(b) - GRAM - p, SIDE), pa.int32()),
                                pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(np.ascontiguousarray(context))]),
                                pa.array(np.zeros(m), pa.int32()), pa.array(np.full(m, SIDE), pa.int32()),
                            ],
                            names=[x.split()[0] for x in CONTEXT.split(", ")],
                        )

    return docs.join(lists, "row").select("row", "text", "at").mapInArrow(tidy(run), CONTEXT)


def _in_buckets(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", "row", "place")


def _shared(df: DataFrame, bucket: Column) -> DataFrame:
    """With the bucket, and whether it is a share of a larger one."""
    share = F.xxhash64(bucket, F.pmod(F.xxhash64("row", "place"), F.ceil(F.col("n") / HOT).cast("long")))
    return df.withColumn("shared", F.col("n") > HOT).withColumn("bucket", F.when(F.col("shared"), share).otherwise(bucket))


def _halves(df: DataFrame) -> DataFrame:
    """Samples that go on, once for each half of their strings that the text has room for, with ``whole``: rank, half and the bytes that its strings have in common."""
    middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
    half = lambda least, most: F.struct(least.alias("least"), most.alias("most"))
    upper = F.when(F.col("least") < F.col("most"), half(middle + 1, F.col("most")))
    ways = F.filter(F.array(half(F.col("least"), middle), upper), lambda h: h.isNotNull() & (F.col("n_before") >= h["least"]) & (F.col("n_after") >= SIDE - h["most"]))
    rows = df.withColumn("h", F.explode(ways)).withColumns({"least": F.col("h.least"), "most": F.col("h.most")}).drop("h")
    same = F.substring(F.col("context"), SIDE + 1 - F.col("least"), F.col("least") + GRAM + SIDE - F.col("most"))
    return rows.withColumn("whole", F.xxhash64("rank", "least", "most", same))


RESULT = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(row: int, text: str | None, spans: list[tuple[int, int]], with_text: bool) -> tuple:
    """RESULT of one text; spans may overlap."""
    b = (text or "").encode()
    kept, at, gone, runs = [], 0, 0, 0
    for start, end in sorted(spans):
        start = max(start, at)
        if end <= at:
            continue
        if start > at or not runs:
            kept.append(b[at:start])
            runs += 1
        gone += end - start
        at = end
    rest = b"".join([*kept, b[at:]])
    return (row, len(b), gone, runs, hashlib.sha256(rest).hexdigest(), *([rest.decode(errors="replace")] * with_text))


def _emit(out: list[tuple], with_text: bool) -> Iterator[pa.RecordBatch]:
    if out:
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text])


def _untouched(docs: DataFrame, bitmap: bytes, with_text: bool) -> DataFrame:
    """RESULT of the rows whose bit is off, which have no spans."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                batch = batch.filter(pa.array(~passes(sent.value, batch.column(2).to_numpy())))
                yield from _emit([_result(row, text, [], with_text) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], with_text)

    return docs.select("row", "text", id_bit("row").alias("bit")).mapInArrow(tidy(run), RESULT + (", kept_text string" if with_text else ""))


def _cut(docs: DataFrame, with_text: bool) -> DataFrame:
    """RESULT of (row, text, starts, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = zip(*(c.to_pylist() for c in batch.columns))
                yield from _emit([_result(row, text, list(zip(starts or (), ends or ())), with_text) for row, text, starts, ends in rows], with_text)

    return docs.select("row", "text", "starts", "ends").mapInArrow(tidy(run), RESULT + (", kept_text string" if with_text else ""))


def repeats(rows: DataFrame) -> DataFrame:
    """(row, start, end) of strings that start earlier too; spans overlap. ``rows``: (row, text)."""
    dealt = _samples(rows).repartition("rank")
    # a rank's rows pass by its count one after another: a frequent one is never held in memory
    often = dealt.groupBy(F.col("rank").alias("c_rank")).agg(F.sum("m").alias("n")).where("n > 1")
    each = F.explode(F.coalesce("more", F.array(F.struct("row", "place"))))
    again = materialize(dealt.join(often, F.col("rank") == F.col("c_rank")).select("rank", "n", each.alias("x")).select("rank", "n", "x.row", "x.place"), "samples")
    open_ = _shared(_contexts(_where(rows, id_filter(again, "row")), again), F.col("rank"))
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    spans = None
    while True:
        done = materialize(_sort_buckets(_in_buckets(open_)), "round")
        found = done.where("row is not null").select("row", "start", "end")
        spans = found if spans is None else spans.unionByName(found)
        on = done.where("s_row is not null").select(*[F.col(f"s_{c}").alias(c) for c in names])
        if not on.limit(1).count():
            return spans
        on = materialize(_halves(on), "halves")
        sizes = on.groupBy(F.col("whole").alias("c_whole")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        open_ = _shared(on.drop("n").join(sizes, F.col("whole") == F.col("c_whole")).select(*names, "whole"), F.col("whole")).drop("whole")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds what is left."""
    rows, ids = unique_ids(docs, id_col, text_col, nulls=True)
    spans = repeats(rows)
    bitmap = id_filter(spans, "row")
    whole = _untouched(rows, bitmap, with_text)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("row", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    cut = _cut(_where(rows, bitmap).join(lists, "row", "left"), with_text)
    out = whole.unionByName(cut)
    if ids is None:
        return out.withColumnRenamed("row", "doc_id")
    return out.join(ids, "row").select("doc_id", *[c for c in out.columns if c != "row"])
