"""Packing of token sequences by minimum bin slack.

Each task reads its documents once, in order, and keeps a window of remainders
(what is left of a document after its full sequences). A sequence is filled
with the longest remainder of the window and those others whose lengths sum
closest to the rest: a subset-sum over a bitset (one big integer), where the
multiset of lengths enters by counts in binary parts and the chosen counts are
found by going back through the parts. What is still open is closed by cutting
the longest remainder that is left. Nothing is shuffled, memory is bounded by
the window, and a task that is run again gives the same sequences.

Rows: a null text is empty, an empty text is the closing id alone, a repeated
row is packed once for each time. A null doc_id is kept. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, tidy

CAPACITY = 4096
END_ID = 2
#: Remainders that a task holds at a time, under CAPACITY ids each.
WINDOW = 256
#: Different words whose ids a Python worker keeps; those not met lately go first.
KNOWN_WORDS = 1_600_000
ID_BYTES = 4
#: Pieces that a task sends at a time.
ROWS = 1024

#: The tokenizer's own cuts in lower-case ASCII without apostrophes, and marks after a letter.
PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
BEYOND = re.compile("[^\\x00-\\xff]")
TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~]+$")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    The tokenizer drops white space and no rule of it reaches across, so a text's
    ids are those of its words in turn, and a word that is known is not encoded
    again. New words are encoded together, parted by a special token, which the
    tokenizer takes out before anything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if not added:
            raise ValueError(f"{path} has no special token to part words by")
        self.mark_id, self.mark = min(added), added[min(added)].encode()
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added.values()))
        #: What every special token begins with.
        self.sign = os.path.commonprefix([t.encode() for t in added.values()])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def special(self, word: bytes) -> bool:
        return self.sign in word and bool(self.added.search(word))

    def parts(self, word: bytes) -> list[bytes]:
        """A word's parts that the tokenizer takes alone, as far as ASCII shows them; else the word."""
        if word.isalpha():  # of bytes: ASCII letters only
            return [word.lower()]
        if b"'" in word or self.special(word):
            return [word]
        if word.isascii():
            return PARTS.findall(word.lower())
        tail = TAIL.search(word)
        if tail and tail.start() and word[: tail.start()].decode()[-1].lower().isalpha():
            return [word[: tail.start()], tail[0]]
        return [word]

    def prepare(self, pieces: list[list[bytes]]) -> None:
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        made, new = [], set()
        for w in set().union(*pieces).difference(known):
            if w in older:
                known[w] = older[w]
                continue
            parts = self.parts(w)
            for p in parts:
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                    else:
                        new.add(p)
            if len(parts) > 1 or parts[0] != w:
                made.append((w, parts))
        apart = [w for w in new if self.special(w)]
        for w in apart:
            known[w] = self.alone(w)
        together = list(new.difference(apart)) if apart else list(new)
        for at in range(0, len(together), 512):
            part = together[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(part, [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]):
                known[w] = raw[begin * ID_BYTES : end * ID_BYTES]
                begin = end + 1
        get = known.__getitem__
        for w, parts in made:
            known[w] = b"".join(map(get, parts))

    def words(self, text: str) -> list[bytes]:
        """A text's words, at ASCII white space only, which the tokenizer drops too. It lowers case itself; done before, fewer words differ."""
        b = text.encode()
        # a mark after a letter might be composed with its small form only; Latin-1 has no such marks
        return b.lower().split() if text.isascii() or not BEYOND.search(text) else b.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.words(t or "") for t in texts]
        self.prepare(pieces)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in pieces]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""

    def make() -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Encoder(path)

    return held(("encoder", path), make)


def closest_sum(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths with counts, at most those given, whose sum is closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, part = counts[length], 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


class Packer:
    """Sequences from documents in turn. A piece: doc_id, start, ids as bytes, ids of the document."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.by_length: dict[int, list] = {}
        self.items = self.ids = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // ID_BYTES
        if n:
            self.by_length.setdefault(n, []).append(piece)
            self.items, self.ids = self.items + 1, self.ids + n

    def take(self, length: int) -> tuple:
        found = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
        self.items, self.ids = self.items - 1, self.ids - length
        return found

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        total, step = len(ids) // ID_BYTES, self.capacity * ID_BYTES
        full = total // self.capacity
        for k in range(full):
            yield [(doc_id, k * self.capacity, ids[k * step : (k + 1) * step], total)]
        self.put((doc_id, full * self.capacity, ids[full * step :], total))
        while self.items >= self.window and self.ids >= self.capacity:
            yield self.fill(self.capacity)

    def fill(self, room: int) -> list[tuple]:
        """One sequence of ``room`` ids, of which the window holds as many at least."""
        out = []
        if (fitting := [n for n in self.by_length if n <= room]):
            seed = max(fitting)
            out.append(self.take(seed))
            room -= seed
            if room:
                for length, count in closest_sum({n: len(x) for n, x in self.by_length.items()}, room).items():
                    out += [self.take(length) for _ in range(count)]
                    room -= length * count
        while room:
            longest = max(self.by_length)
            doc_id, start, ids, total = self.take(longest)
            cut = min(room, longest)
            out.append((doc_id, start, ids[: cut * ID_BYTES], total))
            self.put((doc_id, start + cut, ids[cut * ID_BYTES :], total))
            room -= cut
        return out

    def end(self) -> Iterator[list[tuple]]:
        """The rest: full sequences, then lengths that are powers of two, which need no padding."""
        while self.ids >= self.capacity:
            yield self.fill(self.capacity)
        while self.ids:
            yield self.fill(1 << (self.ids.bit_length() - 1))


def _rows(sequences: Iterable[list[tuple]], first: int, with_ids: bool) -> Iterator[tuple]:
    for k, pieces in enumerate(sequences):
        offset, total = 0, sum(len(p[2]) for p in pieces) // ID_BYTES
        for doc_id, start, ids, n in pieces:
            length = len(ids) // ID_BYTES
            row = (doc_id, start, length, zlib.crc32(ids), n, first + k, offset, total)
            yield (*row, ids) if with_ids else row
            offset += length


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow; ids stay bytes until here."""
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:8]]
    if len(cols) > 8:
        ends = np.cumsum([0, *(len(c) // ID_BYTES for c in cols[8])]).astype(np.int32)
        ids = np.frombuffer(b"".join(cols[8]), dtype="<u4").astype(np.int64)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves. ``capacity`` is a power of two."""
    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrow = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * with_ids)
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(capacity, window)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40

        def sequences() -> Iterator[list[tuple]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                        yield from packer.add(doc_id, ids + end)
            yield from packer.end()

        held = []
        for row in _rows(sequences(), first, with_ids):
            held.append(row)
            if len(held) >= ROWS:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)
