"""Exact top-k search by tiled matrix products.

Candidates are dealt by a hash of the id over tiles of about `tile_rows` rows, queries over
blocks of about `block_rows`. Each (block, tile) pair is one matrix product in one group;
its k best per query are selected by partial selection. The lists are then merged in a
tree of `fan` tiles a step. No group grows with the input: only their number does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE = float(1 << 53)
ENDS = -(1 << 63) + 1, (1 << 63) - 1


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows with an id and a vector of finite components; one row an id."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("vector"))
    good = good.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return good.groupBy("id").agg(F.min("vector").alias("vector"))


def numbers(n):
    """The array 0, 1 ... n - 1."""
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores in order; ties go to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in a type in which their products are exact: doubles, 64-bit integers, else Python's."""
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if bound < SAFE:
        return q, x
    return tuple(v.astype(np.int64) if bound < 2.0**62 else np.frompyfunc(int, 1, 1)(v) for v in (q, x))


def _tile(k: int, scale: float):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"block": [], "tile": [], "query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            q, x = (np.floor(scale * matrix(t.column(1))) for t in (queries, rows))
            q, x = exact(q, x)
            q_ids, ids = queries.column(0).to_numpy(), rows.column(0).to_numpy()
            for a in range(0, len(q), 256):
                product = q[a : a + 256] @ x.T
                product = np.clip(product, *ENDS).astype(np.int64) if product.dtype == object else product.astype(np.int64)
                for i, scores in enumerate(product):
                    other = ids != q_ids[a + i]
                    at = np.flatnonzero(other)[_best(None, ids[other], scores[other], k)] if not other.all() else _best(None, ids, scores, k)
                    out["query_id"].append(np.full(len(at), q_ids[a + i]))
                    out["vec_id"].append(ids[at])
                    out["score"].append(scores[at])
            block, tile = queries.column("block")[0].as_py(), queries.column("tile")[0].as_py()
            n = sum(map(len, out["vec_id"]))
            out["block"], out["tile"] = [np.full(n, block)], [np.full(n, tile)]
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def _merge(k: int, fan: int):
    def run(lists: pa.Table) -> pa.Table:
        query, ids, scores = (lists.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        order = np.lexsort((ids, -scores, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        at = order[rank < k]
        return lists.take(pa.array(at)).select(["block", "tile", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, tile_rows: int = 4096, block_rows: int = 1024, fan: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    is_query is a condition on `id`. Components x become floor(scale * x). A query is compared with
    every row but its own, ties go to the smaller id. Vectors that are null, empty or hold
    null or non-finite components take no part; rows that share an id are one vector,
    the least. Vectors meet only others of their length. Scores beyond 2^63 - 1 count as that,
    on either side of 0. Components whose multiple isn't finite make a vector take no part. Other columns don't
    matter. An empty table gives no rows.
    """
    rows = valid_vectors(vectors, id_col, vector_col).where(F.forall("vector", lambda v: F.abs(v * scale) < float("inf"))).withColumn("size", F.size("vector"))
    sizes = rows.select("size", is_query.cast("int").alias("q")).groupBy("size").agg(F.count("*").alias("n"), F.sum("q").alias("q")).collect()
    found = None
    for size, n, q in sizes:
        tiles, blocks = -(-n // tile_rows), max(1, -(-q // block_rows))
        own = rows.where(F.col("size") == size)
        left = own.where(is_query).select("id", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), F.explode(numbers(F.lit(tiles))).alias("tile"))
        right = own.select("id", "vector", F.explode(numbers(F.lit(blocks))).alias("block"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(tiles)).alias("tile"))
        right = right.toDF("r_id", "r_vector", "r_block", "r_tile")
        part = left.groupBy("block", "tile").cogroup(right.groupBy("r_block", "r_tile")).applyInArrow(_tile(k, scale), "block long, tile long, query_id long, vec_id long, score long")
        while tiles > 1:
            tiles = -(-tiles // fan)
            part = part.withColumn("tile", F.floor(F.col("tile") / fan)).groupBy("block", "tile").applyInArrow(_merge(k, fan), part.schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "block long, tile long, query_id long, vec_id long, score long")
    return found.groupBy("block", "query_id").applyInArrow(_ranked, "query_id long, rank int, vec_id long, score long")


def _ranked(rows: pa.Table) -> pa.Table:
    """A query's at most k rows in order."""
    order = np.lexsort((rows.column("vec_id").to_numpy(), -rows.column("score").to_numpy()))
    rows = rows.take(pa.array(order)).select(["query_id", "vec_id", "score"])
    return rows.add_column(1, "rank", pa.array(np.arange(1, rows.num_rows + 1), pa.int32()))


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id),
w AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
