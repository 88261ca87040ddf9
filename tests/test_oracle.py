"""Every archive query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from parley.operators import windows
from parley.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    found = registry.QUERIES[name](spark, DATA)
    mine = found.collect()
    if name not in registry.ORACLE_SQL:
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    theirs, columns = cursor.fetchall(), [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, mine) == rows_of(columns, theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["w1_assign_pages", "w4_group_albums", "w5_album_continuation", "w7_show_sender", "w10_entry_shards", "w11_prev_next_pages", "j14_chronology_inversions", "s3_read_export_html"])
def test_chats_of_many_blocks(name, spark, duck, monkeypatch):
    """Many more ranges than chats: what is carried between them shows."""
    monkeypatch.setattr(windows, "RANGES", 400)
    found = registry.QUERIES[name](spark, DATA)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    assert rows_of(found.columns, found.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
