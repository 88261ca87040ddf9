"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors become one class with a count, so copies never meet in pairs.
2. On a bounded sample (`sample_rows`) rotations are learned: the principal axes, turned so
   that signs of the coordinates lose as little as possible. Signs are the code's bits.
3. The code is cut into tables of `bits` bits. Two vectors at the threshold's angle agree
   in a bit with probability 1 - angle / pi; the number of tables follows from the wanted
   `recall` at the threshold (more for closer pairs). `bits` grows with the logarithm of the
   number of vectors, so a random bucket stays at about `bucket` vectors.
4. Buckets are compared by matrix products of the original vectors in double precision.
   A bucket of more than `most` vectors is cut into blocks, and each pair of blocks is a
   group: no bucket is capped and no group is unbounded. A pair that an earlier table also
   holds is left to that table, so every link counts once.
5. Groups return link counts per vector and a spanning set of their links; components follow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged, table
from .graph import components
from .topk_search import matrix, numbers, valid_vectors


def rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Principal axes times a turn that brings the rotated sample close to its signs."""
    dim = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    v = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = right.T @ left.T
    return axes @ turn


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by a power of two first, so that squares neither vanish nor overflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def plan(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, n / bucket)))))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _codes(model):
    def run(batches):
        turns, bits, tables = model.value
        weights = (1 << np.arange(bits, dtype=np.int64))[:, None]
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                x = matrix(pa.chunked_array([part.column("vector")]))
                flags = np.concatenate([x @ t > 0 for t in turns], 1)[:, : bits * tables].astype(np.int64)
                keys = np.concatenate([flags[:, t * bits : (t + 1) * bits] @ weights for t in range(tables)], 1)
                yield table({"id": part.column("id"), "copies": part.column("copies"), "vector": part.column("vector"), "codes": pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))})

    return run



def _compare(threshold: float):
    """Compare the rows of block b1 with those of block b2 (the same rows if they are equal)."""

    def run(rows: pa.Table) -> pa.Table:
        t = rows.column("t")[0].as_py()
        b1, b2 = rows.column("b1")[0].as_py(), rows.column("b2")[0].as_py()
        ids, copies, own = (rows.column(c).to_numpy() for c in ("id", "copies", "own"))
        x, codes = matrix(rows.column("vector")), matrix(rows.column("codes"))
        x = unit(x)
        left = np.flatnonzero(own == b1)
        right = np.flatnonzero(own == b2)
        # links as positions, and labels that spread along them
        la, lb = [], []
        for a in range(0, len(left), 512):
            at = left[a : a + 512]
            close = x[at] @ x[right].T >= threshold
            if b1 == b2:
                close &= ids[at][:, None] < ids[right][None, :]
            i, j = np.nonzero(close)
            i, j = at[i], right[j]
            new = ~(codes[i, :t] == codes[j, :t]).any(1)
            la.append(i[new])
            lb.append(j[new])
        i, j = np.concatenate(la), np.concatenate(lb)
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = ids.copy()
        while True:
            before = label.copy()
            np.minimum.at(label, i, before[j])
            np.minimum.at(label, j, before[i])
            if (label == before).all():
                break
        at = np.flatnonzero(links > 0)
        return pa.table({"id": ids[at], "label": label[at], "links": links[at].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99, sample_rows: int = 8192, bucket: int = 16, most: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row's id.

    Vectors link at cosine >= threshold (double precision); none below it is ever linked, and the
    index finds at least `recall` of the pairs at the threshold in expectation. Vectors that are
    null, zero, empty or hold null or non-finite components link with nothing. Rows that
    share an id are one vector, the least. Vectors meet only others of their length. Rows without id
    link with nothing. Other columns don't matter. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    everything = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    good = valid_vectors(vectors, id_col, vector_col).where(F.exists("vector", lambda v: v != 0))
    good = staged(good, folder, "good")
    classes = staged(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), folder, "classes")
    counted, linked = [], []
    for k, (size, n) in enumerate(sorted(classes.groupBy(F.size("vector")).count().collect())):
        own = classes.where(F.size("vector") == size)
        bits, tables = plan(n, threshold, recall, bucket)
        dice = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
        sample = own.where(dice < min(1.0, sample_rows / n)).select("id", "vector").toPandas().sort_values("id")
        x = np.stack(sample["vector"].to_numpy()) if len(sample) else np.ones((1, size))
        x = unit(x)
        model = spark.sparkContext.broadcast(([rotation(x, s) for s in range(-(-bits * tables // size))], bits, tables))
        coded = own.mapInArrow(_codes(model), "id long, copies long, vector array<double>, codes array<long>")
        coded = staged(coded, folder, f"codes-{k}")
        rows = coded.select("id", F.posexplode("codes").alias("t", "code"))
        full = rows.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / most))
        # (id, bucket, own block), then one copy for each pair of blocks that the row is in
        rows = rows.join(full, ["t", "code"]).withColumn("own", F.pmod(F.xxhash64("id", "t"), F.col("blocks")))
        rows = rows.select("id", "t", "code", "own", F.explode(numbers(F.col("blocks"))).alias("with"))
        rows = rows.select("id", "t", "code", "own", F.least("own", "with").alias("b1"), F.greatest("own", "with").alias("b2"))
        rows = rows.join(coded, "id")
        found = rows.groupBy("t", "code", "b1", "b2").applyInArrow(_compare(threshold), "id long, label long, links long")
        found = staged(found, folder, f"found-{k}")
        counted.append(found.groupBy("id").agg(F.sum("links").alias("links")))
        linked.append(found.select(F.col("id").alias("a"), F.col("label").alias("b")))
    members = good.join(classes.withColumnRenamed("id", "rep"), "vector").select("id", "rep", "copies")
    if counted:
        links, pairs = counted[0], linked[0]
        for c, p in zip(counted[1:], linked[1:]):
            links, pairs = links.union(c), pairs.union(p)
        parts = components(pairs, folder, "part").withColumnRenamed("id", "rep")
        members = members.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parts, "rep", "left")
        members = members.select(F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    else:
        members = members.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = everything.join(members, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
