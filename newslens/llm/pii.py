"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find addresses, IPs, card and phone numbers; they stay whatever
the field says. The field decides about weaker mentions: numbers and addresses
written otherwise (no ``+``, other separators, "(at)" and "(dot)") and repeats of
a found value inside other text. An address written otherwise has at most 64
characters before its sign and labels of at most 63, as the format of addresses
has it, and any number of labels. Its variables are a document's mentions:

- unary potentials: shape of the mention and cue words before it; a base match
  is as good as certain;
- chain potentials between neighbours that stand close;
- skip potentials between mentions of equal or similar value (same digits, same
  last ten digits, same address), however far apart. Mentions written alike are
  one variable, and those of one value are tied to one shared variable instead
  of to each other, so n repeats cost n edges.

Loopy sum-product message passing, with damping, runs for ROUNDS rounds; a
mention becomes a span if a label other than none has the most belief and over
half. The potentials are fixed parameters, below.

Work is per document and linear in its length. Rows: a null text is empty, and
has no spans; a null doc_id is kept; repeated rows are treated alike. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The weaker shapes.
WEAK_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[A-Za-z0-9-]{1,63})+", re.I)
WEAK_PHONE = re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
WEAK_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?[.,:_][ ]?|\s?(?:\(dot\)|\[dot\]|\[\.\])\s?)[0-9]{1,3}(?:(?:[ ]?[.,:_][ ]?|\s?(?:\(dot\)|\[dot\]|\[\.\])\s?)[0-9]{1,3}){2}(?![0-9])")
WEAK_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{3,4}(?![0-9])")
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|tarjeta|karte|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
}

# Potentials, in nats. Labels: none, then KINDS.
SURE = 12.0
SHAPE = {"email": 1.0, "ip": -2.0, "card": -2.0, "phone": -2.0}
CUE = 2.5
SKIP = 3.5
CHAIN = 0.4
#: Code points between neighbours that a chain potential spans, and before a mention where a cue counts.
NEAR = 40
ROUNDS = 8
DAMPING = 0.3

_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Goes from sign to sign, so that a long run without one costs nothing."""
    done, at = 0, t.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(t[begin - 1]):
            begin -= 1
        m = DOMAIN.match(t, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = t.find("@", done)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = []
    if "@" in t:
        out += [(a, b, "email") for a, b in _emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _free(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of ``spans``."""
    spans = sorted(spans)
    starts, far, reach = [a for a, _ in spans], [], 0
    for _, b in spans:
        reach = max(reach, b)
        far.append(reach)

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k < 0 or far[k] <= a

    return free


def value_keys(kind: str, s: str) -> list[str]:
    """What mentions of equal or similar value have in common."""
    if kind == "email":
        return ["e:" + re.sub(r"\s", "", re.sub(r"\s?[(\[{](at|dot)[)\]}]\s?", lambda m: "@" if m[1].lower() == "at" else ".", s, flags=re.I)).lower()]
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return ["i:" + ".".join(p.lstrip("0") or "0" for p in parts)]
    d = digits_of(s)
    return ["d:" + d] + (["s:" + d[-10:]] if kind == "phone" and len(d) >= 10 else [])


def mentions(t: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weaker mentions that overlap neither a base span nor each other."""
    free = _free([(a, b) for a, b, _ in base])
    found = []
    if _ANY.search(t):
        if re.search(r"[(\[{]at[)\]}]", t, re.I):
            found += [(*m.span(), "email") for m in WEAK_EMAIL.finditer(t)]
        for pattern, kind in ((WEAK_CARD, "card"), (WEAK_IP, "ip"), (WEAK_PHONE, "phone")):
            found += [(*m.span(), kind) for m in pattern.finditer(t) if kind != "card" or luhn(digits_of(m[0]))]
    for value, kind in {(t[a:b], k) for a, b, k in base}:
        core = value.lstrip("+") if kind == "phone" else value
        at = t.find(core)
        while at >= 0:
            found.append((at, at + len(core), kind))
            at = t.find(core, at + len(core))
    out, end = [], -1
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if a >= end and free(a, b):
            out.append((a, b, kind))
            end = b
    return out


def _normal(m: np.ndarray) -> np.ndarray:
    m = m - m.max(axis=1, keepdims=True)
    return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


def believe(unary: np.ndarray, pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Beliefs of all variables, as logarithms, from unary potentials and pairs whose equal labels gain ``weight``."""
    labels = unary.shape[1]
    source, goal = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    gain = np.concatenate([weight, weight])[:, None, None] * np.eye(labels)
    message = np.zeros((len(source), labels))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, goal, message)
        out = (total[source] - message[back])[:, :, None] + gain
        top = out.max(axis=1, keepdims=True)
        new = _normal((top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :])
        message = DAMPING * message + (1 - DAMPING) * new
    total = unary.copy()
    np.add.at(total, goal, message)
    return _normal(total)


def added_spans(t: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the field adds to the base spans."""
    weak = mentions(t, base)
    if not weak:
        return []
    # mentions written alike are one variable, with the mean of their potentials
    variables: dict[tuple, int] = {}
    scores: list[list[float]] = []
    pairs: dict[tuple[int, int], float] = {}
    place, last = [], None
    for a, b, kind, sure in sorted([(*s, True) for s in base] + [(*s, False) for s in weak]):
        k = variables.setdefault((t[a:b], kind, sure), len(variables))
        if k == len(scores):
            scores.append([])
        scores[k].append(SURE if sure else SHAPE[kind] + CUE * bool(CUES[kind].search(t, max(0, a - NEAR), a)))
        if last and last[1] != k and a - last[0] <= NEAR:
            pairs.setdefault((last[1], k), CHAIN)
        last = (b, k)
        if not sure:
            place.append((a, b, k))
    unary = [[0.0] + [(sum(scores[k]) / len(scores[k])) if kind == x else -SURE for x in KINDS] for (_, kind, _), k in variables.items()]
    hubs: dict[str, int] = {}
    for (value, kind, sure), k in variables.items():
        for key in value_keys(kind, value):
            pairs[k, len(variables) + hubs.setdefault(key, len(hubs))] = SURE if sure else SKIP
    everything = np.concatenate([np.array(unary), np.zeros((len(hubs), len(KINDS) + 1))])
    belief = believe(everything, np.array(list(pairs), dtype=np.int64).reshape(-1, 2), np.array(list(pairs.values())))
    best = belief.argmax(axis=1)
    return [(a, b, KINDS[best[k] - 1]) for a, b, k in place if best[k] and belief[k, best[k]] > np.log(0.5)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_DDL = "array<struct<kind:string,start:long,end:long>>"


def _as_rows(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for a, b, k in spans]


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added, spans: arrays of (kind, start, end) in code points, end exclusive; ``spans`` holds all."""
    schema = f"doc_id long, base {SPAN_DDL}, added {SPAN_DDL}, spans {SPAN_DDL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cols = ([], [], [])
                for t in batch.column(1).to_pylist():
                    base = base_spans(t) if t else []
                    added = added_spans(t, base) if t else []
                    for c, s in zip(cols, (base, added, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))))):
                        c.append(_as_rows(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(SPAN)) for c in cols)], names=["doc_id", "base", "added", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def redact_text(t: str) -> str:
    """``t`` with every span replaced by its kind; overlapping spans become one."""
    base = base_spans(t)
    out, end = [], 0
    for a, b, kind in sorted(base + added_spans(t, base)):
        if a >= end:
            out += [t[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, t[end:]])


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; spans of the text are replaced, and its length is counted anew."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = pa.array([None if t is None else redact_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(tidy(run), docs.schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
