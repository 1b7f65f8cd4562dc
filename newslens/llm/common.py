"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows is broadcast; each row is narrow (under 1 kB), so 20 MB at most.
BROADCAST_ROWS = 20_000

#: Shares into which the rows of a hot key are dealt where a small table is too large to broadcast.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newslens-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newslens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text: pieces of a split, less the empty ones at its ends."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACE + "+")
    empty = lambda c: F.when(c == "", 1).otherwise(0)
    n = F.size(parts) - empty(F.get(parts, F.lit(0))) - F.when(F.size(parts) > 1, empty(F.get(parts, F.size(parts) - 1))).otherwise(0)
    return n.cast("long")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row per key; null keys match null).

    ``small`` is broadcast if a count shows at most BROADCAST_ROWS rows. Beyond
    that, rows of ``big`` are dealt by key and ``salt``, so a hot key is spread.
    """
    spread = small.count() > BROADCAST_ROWS
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [big[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    if spread:
        big = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
        renamed = renamed.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = [big[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [big["_salt"] == F.col("_s")]
    else:
        renamed = F.broadcast(renamed)
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return big.join(renamed, cond, "left").drop("_salt", "_s", *[f"_k_{k}" for k in keys])


#: Bits of an id filter: 2 MB, whatever the input.
FILTER_BITS = 1 << 24
#: Bits of one bitmap of bitmap_construct_agg.
BITMAP = 1 << 15


def id_bit(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, id_col: str) -> bytes:
    """A bitmap with the hashed ids, of fixed size: a row whose bit is off need not be looked at. With more ids than bits it tells nothing, and nothing breaks."""
    bit = id_bit(id_col)
    parts = ids.groupBy(F.floor(bit / BITMAP).alias("b")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(BITMAP))).alias("m")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[r["b"] * BITMAP // 8 : (r["b"] + 1) * BITMAP // 8] = r["m"]
    return bytes(out)


def passes(bitmap: bytes, bits) -> np.ndarray:
    """Which of the bit numbers are on."""
    table = np.frombuffer(bitmap, dtype=np.uint8)
    bits = np.asarray(bits, dtype=np.int64)
    return (table[bits >> 3] >> (bits & 7) & 1).astype(bool)


def unique_ids(docs: DataFrame, id_col: str, text_col: str, *, carry: bool = False, nulls: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(row, text) of the rows with an id, and (row, doc_id) where they differ; with ``carry`` (row, text, own), own being all columns of ``docs``.

    ``row`` is unique and orders as doc_id does. It is doc_id itself where no id
    repeats; where some do, rows are numbered in the order of id and text. Another
    call may number them otherwise. With ``nulls``, rows without an id are numbered
    too, after all others, in the order of text.
    """
    own = [F.struct(*docs.columns).alias("own")] if carry else []
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    df, without = every.where("doc_id is not null"), every.where("doc_id is null")
    kept = ["row", "text", "own"] if carry else ["row", "text"]

    def numbered(rows: DataFrame, first: int) -> DataFrame:
        ordered = rows.repartitionByRange("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 64)).sortWithinPartitions("doc_id", F.asc_nulls_first("text"))
        return materialize(ordered.withColumn("row", F.monotonically_increasing_id() + first), "rows")

    repeated = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    some = nulls and without.limit(1).count()
    if not repeated and not some:
        return df.withColumn("row", F.col("doc_id")).select(*kept), None
    most = df.agg(F.max("doc_id")).first()[0] if some else None
    if repeated or most is not None and most >= 1 << 62:
        out = numbered(df, 0)
        most = out.agg(F.max("row")).first()[0] if some else None
    else:
        out = df.withColumn("row", F.col("doc_id"))
    if some:
        out = out.unionByName(numbered(without, 0 if most is None else max(0, most + 1)))
    return out.select(*kept), out.select("row", "doc_id")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, after which a worker gives back memory that Arrow and the C library hold for later: an executor may keep several workers at rest."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return tidied


_HELD: dict[object, object] = {}


def held(name: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task under a name. Another name lets it go: workers are used for all operators in turn."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, for hashes of stretches from sums of prefixes."""

    ODD = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            back = pow(self.ODD, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)])) for x in (self.ODD, back))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the least hashes of their id.

    Where there are more, a threshold for the hash leaves not many too many, so that
    what meets in one place is bounded by ``rows`` and not by the number of tasks.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30))
    if total > rows:
        df = df.where(place < int(min(1.0, 1.2 * rows / total) * (1 << 30)))
    return df.orderBy(place, id_col).limit(rows)
