"""Exact top-k search by inner product with MaxScore.

A term is a component. A shard is an Arrow batch of candidates, ordered by k-d
splits and cut into blocks of BLOCK; of each block the least and greatest weight
of every term are kept. For a query, a term adds between ``low`` and ``high``;
scores less the sum of all ``low`` are sums of contributions that are not
negative, as MaxScore needs. Against the k-th best score so far (``theta``):

- a block whose bound cannot reach it is skipped, none of its candidates scored;
- terms go by span (``high - low``); the longest run of small spans that cannot
  reach theta by themselves is not essential, the others are. The postings of the
  essential terms are traversed first, for all candidates of the open blocks;
- the other terms are probed from the largest span down, a few at a time, for
  those candidates only that can still get to theta.

Each task carries its best scores from shard to shard; the tasks' results are
merged. Queries come in passes of at most about PASS rows, each sent to all tasks
(16 MB at 64 components), searched, written and released before the next, so any
number of queries is searched with no join.

Scores are exact: in doubles where all sums stay below 2**53, and otherwise in
whole numbers of any size. A best score that a long cannot hold is an error.

Rows: a vector that is null, or that holds a null or a non-finite component,
takes no part, nor does one without an id. Vectors of different length are
compared over the components that both have; an empty one scores 0. Rows that repeat
an id are candidates each. Candidates with the query's own id are left out; of several
queries with one id, the one whose vector sorts first counts. Ties go to the
smaller id. Other columns are not read. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Queries sent to the tasks at a time.
PASS = 32_768
#: Candidates of a block.
BLOCK = 64
#: Terms probed between two prunings.
STEP = 8
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)

SCHEMA = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles, padded with zeros to the longest."""
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    width = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles that are whole numbers; as Python's whole numbers where a double cannot hold the product."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.isfinite(y).all():
        return y
    return np.array([math.floor(v * scale) if math.isfinite(v * scale) else int(v) * int(scale) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _exactly(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Order of rows by k-d splits, so that a block's vectors are alike: halves by the term that varies most, until they fit."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= BLOCK or not x.shape[1]:
            out.append(rows)
            continue
        term = int(x[rows].var(axis=0).argmax())
        cut = len(rows) // 2 // BLOCK * BLOCK or BLOCK
        by = rows[np.argsort(x[rows, term], kind="stable")]
        open_ += [by[cut:], by[:cut]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Shard:
    """Candidates by term, with the blocks' bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, exact: bool = False):
        order = _ordered(x.astype(np.float64) if x.dtype != object else np.clip(x, -1e300, 1e300).astype(np.float64))
        self.ids, x = ids[order], (_exactly(x) if exact else x)[order]
        self.starts = np.arange(0, len(x), BLOCK)
        parts = [x[a : a + BLOCK] for a in self.starts]
        self.least = np.array([p.min(axis=0) for p in parts], dtype=x.dtype).reshape(len(parts), x.shape[1])
        self.most = np.array([p.max(axis=0) for p in parts], dtype=x.dtype).reshape(len(parts), x.shape[1])
        self.x = np.ascontiguousarray(x.T)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Most that a candidate of each block can score, for each of the queries (rows of ``q``)."""
        width = min(q.shape[1], len(self.x))
        q = q[:, :width]
        return np.maximum(q, 0) @ self.most[:, :width].T + np.minimum(q, 0) @ self.least[:, :width].T


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda r: (-r[0], r[1]))[:k]


def search_shard(shard: Shard, bound: np.ndarray, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]], seen: Counter | None = None) -> list[tuple[int, int]]:
    """``best`` (score, id), at most k, with the candidates of a shard. ``bound`` is what its blocks can reach. ``seen`` counts candidates: in skipped blocks, opened, and scored on all terms."""
    seen = Counter() if seen is None else seen
    width = min(len(q), len(shard.x))
    q = q[:width]
    order = np.argsort(-bound, kind="stable")
    at = 0
    while len(best) < k and at < len(order):
        # the first threshold: the most promising blocks in full
        a = int(shard.starts[order[at]])
        at += 1
        ids = shard.ids[a : a + BLOCK]
        score = q @ shard.x[:width, a : a + BLOCK] if width else np.zeros(len(ids))
        best = _best(best + [(s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != query_id], k)
        seen["opened"] += len(ids)
        seen["scored"] += len(ids)
    theta = best[-1][0] if len(best) >= k else None
    if theta is None:
        return best
    blocks = np.sort(order[at:][bound[order[at:]] >= theta])
    rows = (shard.starts[blocks][:, None] + np.arange(BLOCK)).ravel()
    rows = rows[rows < len(shard.ids)]
    seen["skipped"] += sum(min(BLOCK, len(shard.ids) - int(a)) for a in shard.starts[order[at:]]) - len(rows)
    rows = rows[shard.ids[rows] != query_id]
    if not len(rows):
        return best
    seen["opened"] += len(rows)
    a, b = q * shard.least[blocks, :width].min(axis=0), q * shard.most[blocks, :width].max(axis=0)
    low, high = np.minimum(a, b), np.maximum(a, b)
    terms = np.argsort(low - high, kind="stable")  # largest span first
    rest = np.concatenate([np.cumsum(high[terms][::-1])[::-1], [0]])  # most that terms from here on add
    # by themselves, the terms from a place on reach the least of those before and the most of their own
    reach = np.concatenate([[0], np.cumsum(low[terms])]) + rest
    essential = int(np.argmax(reach < theta)) if (reach < theta).any() else width
    if not essential and width:
        return best  # no term is essential: none can enter
    score = q[terms[:essential]] @ shard.x[np.ix_(terms[:essential], rows)] if essential else np.zeros(len(rows))
    for start in range(essential, width, STEP):
        keep = score + rest[start] >= theta
        rows, score = rows[keep], score[keep]
        if not len(rows):
            return best
        probed = terms[start : start + STEP]
        score = score + q[probed] @ shard.x[np.ix_(probed, rows)]
    keep = score >= theta
    seen["scored"] += len(rows)
    return _best(best + list(zip(score[keep].tolist(), shard.ids[rows[keep]].tolist())), k)


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return raw.where(F.col("vec_id").isNotNull() & F.coalesce(valid(F.col("vector")), F.lit(False)))


def _padded(vectors: list[list[float]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = PASS) -> DataFrame:
    """The k best candidates of each query by the inner product of components floor(scale * x): query_id, rank from 1, vec_id, score."""
    spark = candidates.sparkSession
    wanted = vectors(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    passes = max(1, -(-wanted.count() // block))
    rows = vectors(candidates, id_col, vector_col)
    found = None
    for b in range(passes):
        mine = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == b)
        held = sorted((r["vec_id"], r["vector"]) for r in mine.toLocalIterator())
        sent = spark.sparkContext.broadcast(([i for i, _ in held], _padded([v for _, v in held])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, raw = sent.value
            asked = whole(raw, scale)
            best: list[list[tuple[int, int]]] = [[] for _ in names]
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                x = whole(_matrix(batch.column(1)), scale)
                width = min(x.shape[1], asked.shape[1])
                # the largest sum that may occur, in any order of terms
                wide = object in (x.dtype, asked.dtype) or bool(width) and float((np.abs(asked[:, :width]).max(axis=0) * np.abs(x[:, :width]).max(axis=0)).sum()) * 4 >= EXACT
                shard = Shard(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64), x, wide)
                q = _exactly(asked) if wide else asked
                for at in range(0, len(names), 1024):
                    bound = shard.bounds(q[at : at + 1024])
                    for j in range(at, min(at + 1024, len(names))):
                        best[j] = search_shard(shard, bound[j - at], names[j], q[j], k, best[j])
            flat = [(names[j], i, int(s)) for j, hits in enumerate(best) for s, i in hits]
            if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in flat):
                raise OverflowError("a score does not fit a long")
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(tidy(run), SCHEMA)
        if passes > 1:
            part = materialize(part, "best")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
