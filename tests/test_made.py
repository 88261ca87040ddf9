"""Queries against their SQL on tables made by hand."""

import os

import duckdb
from pyspark.sql import functions as F

from parley.plans import fixtures, registry, storage
from parley.plans.fixtures import Archive
from parley.sources import writers

from .test_oracle import rows_of


def compared(spark, folder, name, **tables):
    """The query's rows and those of its SQL over tables: SELECTs of DuckDB."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = registry.QUERIES[name](spark, str(folder))
    cursor = con.execute(registry.ORACLE_SQL[name])
    return rows_of(found.columns, found.collect()), rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_an_owner_without_a_name_goes_by_the_next_one(spark, tmp_path):
    """8500 has neither a name nor a username."""
    mine, theirs = compared(spark, tmp_path, "s9_read_export_owner", customer="SELECT 8500 + i AS c_custkey, 'C' || i AS c_name FROM range(5) r(i) UNION ALL SELECT 0, 'none'")
    assert mine == theirs == [("C1 u8501", 8500)]


CHATS = dict(customer="SELECT i AS c_custkey, 'C' || i AS c_name FROM range(1, 3000) r(i)", orders="SELECT 70000 * i AS o_orderkey, 1 + i % 2999 AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '1996-01-02' AS o_orderdate, 'HIGH' AS o_orderpriority FROM range(1, 6000) r(i)")


def test_the_number_of_exported_files_follows_the_messages(spark, tmp_path, monkeypatch):
    """6,000 messages of far ids in 2,999 chats: by chats and ids they were as many files."""
    monkeypatch.setattr(storage, "FILE_MESSAGES", 1000)
    for name in ("s2_read_export_json", "s2_large_export"):
        mine, theirs = compared(spark, tmp_path, name, **CHATS)
        assert mine == theirs and len(mine) > 5000
    folder = storage._exports(Archive(spark, str(tmp_path)))
    assert len([f for _, _, names in os.walk(folder) for f in names if f.endswith(".txt")]) == 6


def test_chats_of_an_index_share_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("peer_id"), F.col("id").alias("message_id"), F.lit("t").alias("text"))
    writers.write_chat_index(rows, str(tmp_path / "chats"))
    assert len([f for _, _, names in os.walk(tmp_path / "chats") for f in names if f.endswith(".parquet")]) <= 8
    back = spark.read.parquet(str(tmp_path / "chats"))
    assert back.count() == 5000 and sorted(r.message_id for r in back.where("peer_id = 7").collect()) == [7, 1007, 2007, 3007, 4007]


def test_partitions_of_links_follow_the_size_of_files(spark, tmp_path, monkeypatch):
    """Few bytes of shuffle may be many links: their partitions are not put together by the bytes."""
    monkeypatch.setattr(fixtures, "PART_BYTES", 1 << 10)
    lines = "SELECT 70000 * (1 + i % 5999) AS l_orderkey, i % 700 AS l_partkey, CAST(1 + i % 7 AS INTEGER) AS l_linenumber FROM range(20000) r(i)"
    parts = "SELECT i AS p_partkey, CAST(1 + i % 50 AS INTEGER) AS p_size FROM range(700) r(i)"
    mine, theirs = compared(spark, tmp_path, "j2_primary_media_items", lineitem=lines, part=parts, **CHATS)
    assert mine == theirs and len(mine) > 10000
    assert Archive(spark, str(tmp_path)).links.select(F.spark_partition_id()).distinct().count() > 10
