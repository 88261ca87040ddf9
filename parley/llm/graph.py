"""Connected components of a large link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component): the least id reachable, for every id in links (a, b) but those least ones.

    Each round is written out, so lineage stays short; the number of rounds grows
    with the logarithm of the longest chain.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), folder, f"{name}-0")
    state, k = None, 0
    while True:
        k += 1
        edges = staged(_small(_large(edges)), folder, f"{name}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        state = now
