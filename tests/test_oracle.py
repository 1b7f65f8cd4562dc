"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from newslens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(registry.oracle_sql()[name])
    theirs = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert mine == theirs


@pytest.mark.parametrize("name", ["sort_date_desc", "sort_date_asc", "sort_tone_desc", "sort_tone_asc"])
def test_sorts_go_by_what_is_shown(spark, tmp_path, name):
    """Many rows to a second and to a rounded tone, with ids against and along the order within; nulls among them."""
    con = duckdb.connect()
    con.execute(
        """CREATE TABLE events AS SELECT k AS event_id, CASE WHEN k % 31 <> 5 THEN TIMESTAMP '2024-01-30 23:59:58' + to_microseconds(CASE WHEN k < 60 THEN k * 20011 ELSE (120 - k) * 20011 END) END AS ts,
k % 9 AS user_id, CASE WHEN k % 10 = 3 THEN 'view' ELSE 'click' END AS event_type, CASE WHEN k % 37 <> 7 THEN 50 + k % 2 + (k * 17 % 120) * 1e-9 END AS value, '{}' AS props FROM range(120) r(k)"""
    )
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = con.execute(registry.oracle_sql()[name])
    theirs = [tuple(map(plain, r)) for r in found.fetchall()]
    df = registry.queries()[name](spark, str(tmp_path))
    mine = [tuple(map(plain, r)) for r in df.select(*[d[0] for d in found.description]).collect()]
    assert len(mine) == 25 and mine == theirs


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
