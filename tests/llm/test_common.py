import brute
import pytest
from pyspark.sql import functions as F

from newslens.llm import common

TEXTS = [None, "", " ", "a", " a", "a ", "\ta  b\x0b\x0cc\r\n", "é x y\x1cz", " a b", "a" * 5000]


def test_words(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    rows = df.select("k", common.words(F.col("t")).alias("w"), common.n_words(F.col("t")).alias("n")).orderBy("k").collect()
    for r, t in zip(rows, TEXTS):
        assert r["w"] == brute.WORD.findall(t or "") and r["n"] == len(r["w"])


@pytest.mark.parametrize("most", [-1, 20_000])
def test_join_small(spark, monkeypatch, most):
    """Broadcast or salted, a left join in which null keys match."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    big = spark.createDataFrame([(k, None if k % 5 == 0 else f"s{k % 4}", "x" if k % 2 else None) for k in range(200)], "id long, a string, b string")
    small = spark.createDataFrame([(None, None, 1), (None, "x", 2), ("s1", "x", 3), ("s2", None, 4), ("zz", "x", 5)], "a string, b string, v int")
    known = {(r["a"], r["b"]): r["v"] for r in small.collect()}
    out = common.join_small(big, small, ["a", "b"], F.col("id"))
    assert sorted(out.columns) == ["a", "b", "id", "v"]
    rows = out.collect()
    assert len(rows) == 200 and all(r["v"] == known.get((r["a"], r["b"])) for r in rows)


def test_id_filter(spark):
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("row"))
    bitmap = common.id_filter(ids, "row")
    rows = spark.range(5000).select("id", common.id_bit("id").alias("bit")).collect()
    on = common.passes(bitmap, [r["bit"] for r in rows])
    wanted = {r["row"] for r in ids.collect()}
    assert all(on[k] for k, r in enumerate(rows) if r["id"] in wanted)
    assert sum(on) < len(wanted) + 20
    assert not any(common.id_filter(ids.where("false"), "row"))


def test_bounded_sample(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"))
    a = {r["doc_id"] for r in common.bounded_sample(df, "doc_id", 500).collect()}
    b = {r["doc_id"] for r in common.bounded_sample(df.repartition(7), "doc_id", 500).collect()}
    assert a == b and 400 < len(a) <= 500
    assert common.bounded_sample(df, "doc_id", 20_000).count() == 10_000


def test_unique_ids(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a"), (None, "n"), (2, "a"), (1, None)], "doc_id long, text string").repartition(3)
    rows, ids = common.unique_ids(df, "doc_id", "text")
    named = [(r["doc_id"], r["text"]) for r in rows.join(ids, "row").orderBy("row").collect()]
    assert named == [(1, None), (1, "z"), (2, "a"), (2, "a"), (2, "b")]
    assert common.unique_ids(df.where("text = 'z'"), "doc_id", "text")[1] is None


def test_shared_dir_is_the_session_s(spark):
    assert common.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
