"""Set-similarity join of documents by n-gram Jaccard, with a token-group matrix.

1. Counts, one pass: in how many documents each token (shingle) is, over the
   quarter of tokens with the smallest hashes, which hold nearly all first tokens.
   Two bitmaps of fixed size keep which are in several, and which are frequent.
2. Signatures, one pass: a document's set of n-word shingles (64-bit hashes), its
   size, a fingerprint of the set, least hashes, and the first tokens of the set in
   a global order: infrequent counted ones by hash, then other infrequent ones, then
   frequent ones. A document that needs more than the first of these keeps its
   other tokens, which are counted among such documents. Tokens known to be in one
   document only are left out. Equal sets are one class, stood for by its smallest
   document.
3. Partition. Representatives that agree in a least hash are compared with the
   smallest of them. Those that are similar at all (WEAK) are in the group of the
   smallest such leader. A group is as wide as similarity to one document allows; chains do not
   make it grow.
4. Token-group matrix. A group stores the union of its members' first tokens,
   with the range of their sizes, one row per token and group. If two sets link,
   their first tokens have a number in common that follows from their sizes; a
   query document whose tokens meet a group's union less often than it would have to
   for any size in the group's range links with none of its members.
5. Only qualifying groups are opened, and of these only such as are not connected
   already: a group's members and its queries are compared exactly, on whole sets,
   in blocks of bounded size, by products of token matrices. Documents known to be
   connected share parts, so that no block holds two parts of one component, nor parts whose
   sizes cannot link. A block gives no pairs, only what connects its documents.
6. Components of all links found. No link between different components is lost.

The order needs only be the same for all documents: it affects the number of
groups opened, never the result. Texts are read again where sets are compared; a
bitmap tells which, and no text is shuffled.

Rows: a document without words has an empty set and links with none. Rows that
repeat a doc_id, and rows whose doc_id is null, are documents of their own, and
their component is told by their doc_id; null comes after all others. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP, POWERS, id_bit, id_filter, materialize, passes, tidy, unique_ids

N = 4
#: The threshold, as parts of a hundred.
PERCENT = 85
#: Common first tokens that a group needs to qualify.
SHARED = 3
#: Least hashes by which documents are brought together, and the similarity, in parts of a hundred, of a group's documents.
MINIMA = 8
WEAK = 50
#: Documents and tokens of one part of a group; a block has two parts.
PART = 1024
PART_TOKENS = 4_000_000
#: Tokens of a matrix that is multiplied at a time.
COLUMNS = 4096
#: Documents that a frequent token is in; tokens are counted if their hash is below COUNTED.
FREQUENT = 32
COUNTED = np.uint64(1 << 62)
#: Bits of the two bitmaps, 4 MB each.
BITS = 1 << 25
#: Bytes of a text whose words are hashed together.
BLOCK = 1 << 21

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)
_ONE = np.uint64(1)
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SEEDS = np.array([0x27D4EB2F165667C5 * (2 * k + 3) % (1 << 64) | 1 for k in range(MINIMA)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, with A-Z in lower case."""
    # on bytes, lower() changes A-Z only
    a = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    gap = np.ones(len(a) + 2, dtype=bool)
    gap[1:-1] = _GAP[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        begin, end = int(starts[at]), int(ends[to - 1])
        up, down = POWERS.get(end - begin)
        total = np.zeros(end - begin + 1, dtype=np.uint64)
        np.cumsum((a[begin:end] + _ONE) * up, out=total[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _B)
        at = to
    return out


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence if there are fewer words."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _A + h[k : len(h) - size + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def misses(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a set which links with it may lack."""
    return n - -(-percent * n // 100)


def _on(bitmap: bytes, tokens: np.ndarray) -> np.ndarray:
    bits = (tokens & np.uint64(BITS - 1)).astype(np.int64)
    return (np.frombuffer(bitmap, dtype=np.uint8)[bits >> 3] >> (bits & 7) & 1).astype(bool)


def wanted(n: int, percent: int = PERCENT) -> int:
    """How many first tokens a set of n needs."""
    return min(n, misses(n, percent) + SHARED)


def counted_first(tokens: np.ndarray, several: bytes, frequent: bytes, percent: int = PERCENT) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Of a sorted set: the infrequent counted tokens that come first, without those that no other document has; how many tokens are missing; and if any are, the others."""
    want = wanted(len(tokens), percent)
    cut = int(np.searchsorted(tokens, COUNTED))
    low = tokens[:cut]
    often = _on(frequent, low)
    rare = low[~often][:want]
    first = rare[_on(several, rare)]
    if len(rare) == want:
        return first, 0, None
    return first, want - len(rare), np.concatenate([tokens[cut:], low[often]])


def late_first(tokens: np.ndarray, need: int, several: bytes, frequent: bytes) -> np.ndarray:
    """The ``need`` tokens that come next: of those not counted at first, the infrequent; then the frequent. Without those that no other document has."""
    open_ = tokens >= COUNTED
    often = ~open_ | _on(frequent, tokens)
    chosen = np.concatenate([tokens[~often], np.sort(tokens[often])])[:need]
    return chosen[(chosen < COUNTED) | _on(several, chosen)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def token_bitmaps(docs: DataFrame, n: int) -> tuple[bytes, bytes]:
    """Which counted tokens are in several documents, and which in FREQUENT or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 4096):
            sets = [shingles(t, n) for t in batch.column(0).to_pylist()]
            token, count = np.unique(np.concatenate([s[: np.searchsorted(s, COUNTED)] for s in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count, pa.int64())], names=["token", "n"])

    return bitmaps_of(docs.select("text").mapInArrow(tidy(run), "token long, n long"))


def bitmaps_of(tokens: DataFrame) -> tuple[bytes, bytes]:
    """From (token, n), whose n are still to be added up: which tokens are in several documents, and which in FREQUENT or more."""
    counts = tokens.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.col("token").bitwiseAND(F.lit(BITS - 1))
    place = F.pmod(bit, F.lit(BITMAP))
    parts = counts.groupBy(F.floor(bit / BITMAP).alias("b")).agg(F.bitmap_construct_agg(place).alias("several"), F.bitmap_construct_agg(F.when(F.col("n") >= FREQUENT, place)).alias("frequent")).collect()
    out = bytearray(BITS // 8), bytearray(BITS // 8)
    for r in parts:
        for bits, part in zip(out, (r["several"], r["frequent"])):
            bits[r["b"] * BITMAP // 8 : (r["b"] + 1) * BITMAP // 8] = part
    return bytes(out[0]), bytes(out[1])


def signatures(docs: DataFrame, bitmaps: Broadcast, n: int, percent: int) -> DataFrame:
    """(row, n, f1, f2, m0.., need, first, late): size, fingerprint, least hashes, and first tokens as far as they are counted."""
    names = ["row", "n", "f1", "f2", *[f"m{k}" for k in range(MINIMA)], "need", "first", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                s = shingles(text, n)
                x = xxhash.xxh3_128_intdigest(s.tobytes())
                least = [int((s * seed).min().view(np.int64)) if len(s) else None for seed in _SEEDS]
                first, need, late = counted_first(s, *bitmaps.value, percent)
                for c, v in zip(cols, [len(s), (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63), *least, need, first.view(np.int64), None if late is None else late.view(np.int64)]):
                    c.append(v)
            kinds = [pa.int64()] * (len(names) - 3) + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = ", ".join(f"{c} long" for c in names[:-2]) + ", first array<long>, late array<long>"
    return docs.select("row", "text").mapInArrow(tidy(run), schema)


def all_first(reps: DataFrame) -> DataFrame:
    """(row, n, first) with the tokens that signatures still miss: the tokens left of these documents are counted among them."""
    short = reps.where("need > 0").select(F.explode("late").alias("token"), F.lit(1).cast("long").alias("n"))
    sent = reps.sparkSession.sparkContext.broadcast(bitmaps_of(short.where((F.col("token") < 0) | (F.col("token") >= int(COUNTED)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            first = []
            for need, early, late in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if need:
                    early = [*early, *late_first(np.array(late, dtype=np.int64).view(np.uint64), need, *sent.value).view(np.int64).tolist()]
                first.append(early)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.list_(pa.int64()))], names=["row", "n", "first"])

    return reps.select("row", "n", "need", "first", "late").mapInArrow(tidy(run), "row long, n long, first array<long>")


def sets_of(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(row, tokens) of at least the rows in the pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            batch = batch.filter(pa.array(passes(sent.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, n).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["row", "tokens"])

    return materialize(docs.select("row", "text", id_bit("row").alias("bit")).mapInArrow(tidy(run), "row long, tokens binary"), "sets")


def compared(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar to WEAK of a hundred, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep, link = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= min(WEAK, percent) * (len(p) + len(q) - both))
                link.append(100 * both >= percent * (len(p) + len(q) - both))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_())], names=["a", "b", "link"])
            yield out.filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("row").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("row").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(tidy(run), "a long, b long, link boolean"), "compared")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.cumsum(count > 1) - 1
    some = count[column] > 1
    row, column = row[some], place[column[some]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (begin, begin + COLUMNS)))
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[row[at], column[at] - begin] = 1
        out += x @ x.T
    return out.astype(np.int64)


def connected(rows: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets, one for each set but the first of a component."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    both = overlaps(sets)
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    out, left = [], np.ones(len(sets), dtype=bool)
    while left.any():
        start = int(np.flatnonzero(left)[0])
        left[start] = False
        front = [start]
        while front:
            k = front.pop()
            found = np.flatnonzero(link[k] & left)
            left[found] = False
            out += [(int(rows[k]), int(rows[j])) for j in found]
            front += found.tolist()
    return out


def opened(sets: DataFrame, jobs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the documents of each job. ``jobs``: (h, i, j, row), a bounded number of rows for each (h, i, j)."""

    def run(table: pa.Table) -> pa.Table:
        rows, first = np.unique(table.column("row").to_numpy(), return_index=True)
        tokens = table.column("tokens").to_pylist()
        edges = connected(rows, [np.frombuffer(tokens[k], dtype=np.uint64) for k in first], percent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return materialize(jobs.join(sets, "row").groupBy("h", "i", "j").applyInArrow(run, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(row, component) of all rows of the edges (a, b): the smallest row that can be reached.

    Rows take the least label of themselves and their neighbours, then the label
    of their label, until nothing changes; only rows with links take part.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    label = materialize(both.groupBy(F.col("a").alias("row")).agg(F.least(F.col("row"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("row").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("row")).agg(F.min("c").alias("c"))
        best = label.join(near, "row").select("row", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = label.select(F.col("row").alias("component"), F.col("component").alias("further"))
        new = materialize(best.join(jump, "component").select("row", "old", F.least("component", "further").alias("component")), "labels")
        if not new.where("old <> component").limit(1).count():
            return new.select("row", "component")
        label = new.select("row", "component")


def least_common(n: str, other: str, percent: int) -> str:
    """First tokens that sets of n and of ``other`` tokens have in common at least, if they link; one less, for rounding."""
    need = lambda x: f"(({percent} * {x} + 99) div 100)"
    both = f"(({percent} * ({n} + {other}) + {99 + percent}) div {100 + percent})"
    return f"{both} - greatest({need(n)}, {need(other)}) + {SHARED - 1}"


def blocks(together: DataFrame, percent: int) -> DataFrame:
    """(h, i, j, row): which documents of a group are compared in which block, two parts i and j. ``together``: (h, row, n, c), c being what is known to be connected."""
    known = together.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"))
    fill = lambda k, t: F.greatest(F.ceil(k / PART), F.ceil(t / PART_TOKENS))
    # a large component has parts of its own, small ones share parts
    known = known.withColumn("large", (4 * F.col("k") > PART) | (4 * F.col("t") > PART_TOKENS)).withColumn("own", fill(F.col("k"), F.col("t")))
    of_small = lambda c: F.sum(F.when(~F.col("large"), F.col(c)).otherwise(0))
    open_ = known.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), of_small("k").alias("sk"), of_small("t").alias("st")).where("x <> y")
    known = known.join(open_.select("h", F.greatest(F.lit(1), fill(2 * F.col("sk"), 2 * F.col("st"))).alias("shared")), "h").select("h", "c", "large", "own", "shared")
    part = F.when(F.col("large"), F.struct("large", "c", F.pmod(F.xxhash64("row"), "own").alias("p"))).otherwise(F.struct("large", F.lit(0).cast("long").alias("c"), F.pmod(F.xxhash64("c"), "shared").alias("p")))
    dealt = materialize(together.join(known, ["h", "c"]).select("h", "row", "n", part.alias("part")), "dealt")
    parts = dealt.groupBy("h", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = (parts.select("h", F.col("part").alias(x), F.col("least").alias(f"least_{x}"), F.col("most").alias(f"most_{x}")) for x in "ij")
    pairs = a.join(b, "h").where("i <= j and not (i.large and j.large and i.c = j.c)").where(f"100 * most_i >= {percent} * least_j and 100 * most_j >= {percent} * least_i").select("h", "i", "j")
    sides = pairs.withColumn("part", F.explode(F.array_distinct(F.array("i", "j"))))
    return dealt.join(sides, ["h", "part"]).select("h", "i", "j", "row")


def links(docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives that connect all that are connected. ``reps``: the signatures of the representatives."""
    narrow = reps.drop("need", "first", "late")
    # 3. stars around the smallest document with a least hash
    least = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(MINIMA)])).alias("x")
    agree = narrow.select("row", "n", least).select("row", "n", "x.k", "x.m")
    # written, so that a frequent least hash is dealt anew where the two meet
    lead = materialize(agree.groupBy("k", "m").agg(F.min(F.struct("row", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("k", "m", F.col("lead.row").alias("b"), F.col("lead.n").alias("bn")), "leaders")
    stars = agree.withColumnsRenamed({"row": "a", "n": "an"}).join(lead, ["k", "m"]).where(f"a <> b and 100 * least(an, bn) >= {WEAK} * greatest(an, bn)").select("a", "b")
    stars = materialize(stars.distinct(), "stars")
    judged = compared(sets_of(docs, stars, n), stars, percent)
    edges = judged.where("link").select("a", "b")
    group, part = judged.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("g")), components(edges)
    # 4. the matrix
    named = materialize(all_first(reps), "first").join(group, "row", "left").join(part.withColumnRenamed("component", "c"), "row", "left")
    named = materialize(named.select("row", "n", F.coalesce("g", "row").alias("g"), F.coalesce("c", "row").alias("c"), "first"), "groups")
    entries = named.select("row", "n", "g", "c", F.explode("first").alias("token"))
    several = entries.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token")
    entries = materialize(entries.join(several, "token"), "shared")
    matrix = entries.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = entries.join(matrix, "token").where("g <> h").where(f"100 * n >= {percent} * least and 100 * most >= {percent} * n")
    met = met.groupBy("row", "n", "c", "h").agg(F.count(F.lit(1)).alias("common"), F.min("least").alias("least"), F.max("most").alias("most"))
    met = met.withColumn("lo", F.expr(f"greatest(least, ({percent} * n + 99) div 100)")).withColumn("hi", F.expr(f"least(most, 100 * n div {percent})"))
    queries = met.where(f"common >= least({least_common('n', 'lo', percent)}, {least_common('n', 'hi', percent)})").select("h", "row", "n", "c")
    # 5. groups with their queries, in blocks
    together = materialize(named.select(F.col("g").alias("h"), "row", "n", "c").unionByName(queries), "opened")
    jobs = materialize(blocks(together, percent), "jobs")
    if not jobs.limit(1).count():
        return edges
    return edges.unionByName(opened(sets_of(docs, jobs.select(F.col("row").alias("a"), F.col("row").alias("b")), n), jobs, percent))


def components_of(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, n_shingles, class_row, component_row) from (row, text): the smallest row with the same set, and the smallest of the component."""
    spark = rows.sparkSession
    bitmaps = spark.sparkContext.broadcast(token_bitmaps(rows, n))
    signed = materialize(signatures(rows, bitmaps, n, percent), "signatures")
    same = signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("row").alias("rep"))
    same = materialize(same, "classes")
    reps = materialize(signed.join(same.select(F.col("rep").alias("row")), "row"), "representatives")
    edges = links(rows, reps, n, percent)
    found = components(edges).withColumnRenamed("row", "rep")
    classes = same.join(found, "rep", "left").select("n", "f1", "f2", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.select("row", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    return out.select("row", F.col("n").alias("n_shingles"), F.coalesce("rep", "row").alias("class_row"), F.coalesce("component", "row").alias("component_row"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (the smallest document with the same set), component_id; and row, which is doc_id unless ids repeat."""
    rows, ids = unique_ids(docs, id_col, text_col, nulls=True)
    out = components_of(rows, n, percent)
    if ids is None:
        return out.select("row", "n_shingles", F.col("class_row").alias("class_id"), F.col("component_row").alias("component_id"), F.col("row").alias("doc_id"))
    name = lambda c: ids.select(F.col("row").alias(f"{c}_row"), F.col("doc_id").alias(f"{c}_id"))
    out = out.join(ids, "row").join(name("class"), "class_row").join(name("component"), "component_row")
    return out.select("row", "n_shingles", "class_id", "component_id", "doc_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the smallest doc_id (null last), and of several with that id the one with the smallest text.

    Rows that a bitmap of fixed size shows to stay are not shuffled. Rows are numbered
    once, with all columns where ids repeat, and told apart by that number.
    """
    rows, _ = unique_ids(docs, id_col, text_col, carry=True, nulls=True)
    go = materialize(components_of(rows.select("row", "text"), n, percent).where("row <> component_row").select(F.col("row").alias("_row")), "copies")
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(go, "_row"))
    split = rows.select("own.*", F.col("row").alias("_row"), id_bit("row").alias("_bit"))

    def only(on: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                keep = passes(sent.value, batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(keep if on else ~keep)).select(list(range(batch.num_columns - 1)))

        return split.mapInArrow(tidy(run), split.drop("_bit").schema)

    return only(False).drop("_row").unionByName(only(True).join(go, "_row", "left_anti").drop("_row"))
