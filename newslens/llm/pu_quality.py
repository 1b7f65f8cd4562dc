"""Quality classifier by positive-unlabelled learning.

A text becomes some thirty measures of its form: lengths, shares of kinds of
characters, repeats of words, word strings and lines, marks between words. A
small network with one hidden layer scores them. It is trained on trusted
positives and on unlabelled texts by minimising the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss; where the second term falls below zero, a step is taken up
its gradient instead, which is what keeps a flexible model from fitting the
positives alone. The class prior is estimated from the labels that may be learnt
from, as the share of positives among them.

At most FIT_ROWS positives and as many unlabelled rows, chosen by a hash, are
sent to the driver, as measures; every text is measured once, in one pass.

Rows: a null or empty text is measured as an empty one. A null doc_id is kept;
repeated rows score alike. Without positives, or without unlabelled rows, all
scores are the prior (one half without labels). An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, tidy

FIT_ROWS = 20_000
HIDDEN = 24
STEPS = 3000
BATCH = 1024
RATE = 0.01
DECAY = 1e-4

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"#*$%&|<>", b"{}[]=+_/\\~^@`")):
    _CLASS[list(_chars)] = _k + 1
CLASSES = 11
_MARKS = b"#*$%&|<>!?"


def measure(text: str | None) -> np.ndarray:
    t = text or ""
    b = t.encode()
    words = b.split()
    n = len(words)
    one = max(n, 1)
    kinds = np.bincount(_CLASS[np.frombuffer(b, dtype=np.uint8)], minlength=CLASSES) / max(len(b), 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    count = Counter(words)
    top = count.most_common(1)[0][1] if n else 0
    pairs = len(set(zip(words, islice(words, 1, None))))
    threes = len(set(zip(words, islice(words, 1, None), islice(words, 2, None))))
    same = sum(map(eq, words, islice(words, 1, None)))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = Counter(w[-1] for w in words)
    marked = sum(ends.get(c, 0) for c in _MARKS) / one
    stops = (ends.get(46, 0) + ends.get(33, 0) + ends.get(63, 0)) / one
    upper = sum(map(bytes.isupper, words)) / one
    return np.array(
        [
            np.log1p(n), np.log1p(len(b)), float(n < 5), float(n < 10), float(n < 20), *kinds,
            lengths.mean() if n else 0.0, lengths.std() if n else 0.0, np.log1p(lengths.max()) if n else 0.0,
            len(count) / one, top / one, pairs / max(n - 1, 1), threes / max(n - 2, 1), same / one,
            (len(lines) - len(set(lines))) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
            marked, stops, upper, sum(v for c, v in ends.items() if 48 <= c <= 57) / one, float(n == 0),
        ],
        dtype=np.float32,
    )


WIDTH = len(measure("a"))


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.shift) / self.scale, -6, 6)
        h = np.tanh(z @ self.w1 + self.b1)
        return z, h, h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))


def constant(prior: float) -> Network:
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> Network:
    """Adam steps on the non-negative risk."""
    if not len(positive) or not len(unlabelled):
        return constant(prior)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-3, rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    names = ("w1", "b1", "w2", "b2")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, STEPS + 1):
        p = positive[rng.integers(0, len(positive), BATCH)].astype(np.float64)
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)].astype(np.float64)
        z, h, g = net.forward(np.concatenate([p, u]))
        gp, gu = g[:BATCH], g[BATCH:]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d = np.concatenate([-prior * sigmoid(gp) / BATCH, sigmoid(gu) / BATCH])  # of the part that must not be negative
        if negative >= 0:
            d[:BATCH] -= prior * sigmoid(-gp) / BATCH
        else:
            d = -d
        dh = d[:, None] * net.w2 * (1 - h * h)
        slopes = {"w1": z.T @ dh + DECAY * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ d + DECAY * net.w2, "b2": d.sum()}
        rate = RATE * (1 - t / (STEPS + 1))
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * slopes[k]
            second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
            setattr(net, k, getattr(net, k) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
    return net


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the measures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = [measure(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, x array<float>")


def _take(df: DataFrame) -> np.ndarray:
    """The measures of FIT_ROWS rows, chosen by a hash of their id."""
    x = bounded_sample(df, "doc_id", FIT_ROWS).select("x").toPandas()["x"]
    return np.array(x.tolist(), dtype=np.float32).reshape(-1, WIDTH)


def fit(x: DataFrame, labels: DataFrame, unlabelled: Column) -> Network:
    """``x``: measures; ``labels``: (doc_id, quality) of the rows that may be learnt from; ``unlabelled``: which other rows may serve."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    share = known.agg(F.avg("quality").alias("p")).first()["p"]
    prior = 0.5 if share is None else float(share)
    positive = _take(x.join(known.where("quality = 1"), "doc_id", "left_semi"))
    rest = _take(x.where(unlabelled).join(labels.select("doc_id"), "doc_id", "left_anti"))
    return train(positive, rest, prior)


def score(x: DataFrame, net: Network) -> DataFrame:
    """doc_id, score."""
    sent = x.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(a), pa.float64())], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, unlabelled: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of all rows, by a network trained on some of them."""
    x = materialize(measures(docs, id_col=id_col, text_col=text_col), "measures")
    return score(x, fit(x, labels, unlabelled))
