"""Toxicity: a factorization machine over hashed terms.

The score of a document is a bias, a linear weight for each of its terms and, for
every pair of terms, the product of their factor vectors: an insult next to a group's
name counts more than the two alone. Terms are the lower-cased words without outer
punctuation, and the first bytes of longer words; both are hashed into a fixed number
of buckets. Learned by AdaGrad on a bounded sample (`sample_per_class` labelled
documents of each class, in expectation, chosen by a hash of the id). Terms are learned whose
presence depends on the class (the likelihood ratio of their counts reaches `least_ratio`), and
terms of pairs whose joint presence does, more than either term's: else they can't be told from chance.
Copies in the sample count once.
Scoring is one pass over the documents with no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTES, SECOND, Words, fold, give_back, lists, sliced, spans_hash, table, text_rows, unused

BITS = 18
OUTER = np.zeros(256, bool)
OUTER[[b for b in range(128) if not chr(b).isalnum()]] = True


def terms(column: pa.Array, prefix: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each row, row after row, and how many each row has."""
    words = Words(column, lower=True)
    start, end = words.bytes_from.copy(), words.bytes_to.copy()
    for _ in range(4):
        start += (end - start > 1) & OUTER[words.raw[start]] if len(start) else 0
        end -= (end - start > 1) & OUTER[words.raw[end - 1]] if len(start) else 0
    rows = words.row_of().astype(np.uint64)
    long = end - start > prefix
    shift = np.uint64(64 - BITS)
    whole = spans_hash(words.raw, start, end, BYTES) >> shift
    head = spans_hash(words.raw, start[long], start[long] + prefix, SECOND) >> shift
    key = np.unique(np.concatenate([rows << np.uint64(BITS) | whole, rows[long] << np.uint64(BITS) | head]))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int32), np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(words.counts))


def _features(batches):
    for batch in sliced(batches):
        at, sizes = terms(batch.column("text"))
        yield table({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "at": lists(at, sizes, pa.int32())})


class Machine:
    """bias + sum w_i + sum over pairs v_i . v_j, for terms that are present."""

    def __init__(self, factors: int = 6, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(1 << BITS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (1 << BITS, factors)).astype(np.float32)
        self.known = np.zeros(1 << BITS, bool)

    def raw(self, at: np.ndarray) -> float:
        at = at[self.known[at]]
        v = self.v[at]
        s = v.sum(0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum()))

    def train(self, rows: list[tuple[np.ndarray, int]], least_ratio: float) -> None:
        """Learn the terms that tell the classes apart, alone or in pairs."""
        self.known = likelihood_ratio(rows) >= least_ratio
        self.known[telling_pairs(rows, least_ratio)] = True
        self.learn(rows)

    def learn(self, rows: list[tuple[np.ndarray, int]], epochs: int = 10, rate: float = 0.15, shrink_w: float = 2e-4, shrink_v: float = 2e-3) -> None:
        rows = [(at[self.known[at]], y) for at, y in rows]
        gw, gv, gb = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-1, np.float32), 1e-2
        order, toxic = np.random.default_rng(3), sum(y for _, y in rows)
        # the rarer class counts for more, up to a bound
        weight = min(4.0, max(1.0, (len(rows) - toxic) / max(1, toxic)))
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                at, y = rows[k]
                v = self.v[at]
                s = v.sum(0)
                score = self.bias + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum())
                g = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
                g *= weight if y else 1.0
                gb += g * g
                self.bias -= rate * g / np.sqrt(gb)
                step = g + shrink_w * self.w[at]
                gw[at] += step * step
                self.w[at] -= rate * step / np.sqrt(gw[at])
                step = np.clip(g * (s - v), -1, 1) + shrink_v * v
                gv[at] += step * step
                self.v[at] = np.clip(v - 0.25 * rate * step / np.sqrt(gv[at]), -1, 1)


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = 3000, least_ratio: float = 10.0) -> Machine:
    """Learn from docs (doc_id, text) that labels (doc_id, toxic 0 or 1) marks. Rows without a label don't count."""
    labels = text_rows(labels, "doc_id", "toxic").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    machine = Machine()
    if not sizes:
        machine.bias = -3.0
        return machine
    share = F.when(F.col("toxic") == 1, min(1.0, sample_per_class / sizes.get(1, 1))).otherwise(min(1.0, sample_per_class / sizes.get(0, 1)))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / (1 << 30)
    # the sample's ids are bounded by its size, so they are sent to the texts, not the texts to them
    rows = text_rows(docs, "doc_id", "text").join(F.broadcast(labels.where(dice < share)), "doc_id").mapInArrow(_features, "doc_id long, toxic int, at array<int>").toArrow()
    machine.train(distinct_rows(rows), least_ratio)
    del rows
    give_back()
    return machine


def distinct_rows(rows: pa.Table) -> list[tuple[np.ndarray, int]]:
    """The terms and label of each row by doc_id, copies once; terms are views of the table's own."""
    at, toxic = (rows.column(c).combine_chunks() for c in ("at", "toxic"))
    ends, flat = at.offsets.to_numpy(), at.values.to_numpy()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    found = {}
    for k in order.tolist():
        terms_of, y = flat[ends[k] : ends[k + 1]], toxic[k].as_py()
        found[hashlib.sha256(terms_of.tobytes()).digest(), y] = (terms_of, y)
    return list(found.values())


def ratio_of(seen: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of `presence depends on the class`, from the counts of either class."""
    total, all_rows, ratio = seen[0] + seen[1], max(size.sum(), 1), 0.0
    for y in (0, 1):
        for count, share in ((seen[y], total), (size[y] - seen[y], all_rows - total)):
            expected = share * (size[y] / all_rows)
            ratio = ratio + 2 * count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9))
    return ratio


def likelihood_ratio(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The ratio of every bucket."""
    seen, size = np.zeros((2, 1 << BITS)), np.zeros(2)
    for at, y in rows:
        seen[y, at] += 1
        size[y] += 1
    return ratio_of(seen, size)


def telling_pairs(rows: list[tuple[np.ndarray, int]], least_ratio: float, block: int = 512) -> np.ndarray:
    """Terms of pairs that tell more together than either does alone.

    The ratio of a pair's joint counts must pass that of its better term by `least_ratio` and
    by what the best of so many pairs reaches by chance. Terms too rare for that are left out first,
    so no such pair is lost; the rest is bounded by the sample. Presence is kept as bits, and joint counts
    of `block` by `block` terms at a time.
    """
    marks = np.array([y for _, y in rows])
    size = np.bincount(marks, minlength=2).astype(float)
    if not size.all():
        return np.zeros(0, np.int64)
    found = np.zeros(1 << BITS)
    for at, _ in rows:
        found[at] += 1
    # the most that a pair with the term can reach: all of its rows in one class
    reach = np.maximum(ratio_of([np.minimum(found, size[0]), 0 * found], size), ratio_of([0 * found, np.minimum(found, size[1])], size))
    kept = np.flatnonzero(reach >= least_ratio)
    least = least_ratio + 2 * np.log(max(1, len(kept) * (len(kept) - 1) / 2))
    kept = np.flatnonzero(reach >= least)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    sides = [presence([rows[k][0] for k in np.flatnonzero(marks == y)], place, len(kept)) for y in (0, 1)]
    of_terms = lambda side, a: np.unpackbits(side[:, a : a + block], axis=0).astype(np.float32)
    own = ratio_of([np.concatenate([of_terms(side, a).sum(0, dtype=float) for a in range(0, len(kept), block)] or [np.zeros(0)]) for side in sides], size)
    out = np.zeros(len(kept), bool)
    for a in range(0, len(kept), block):
        left = [of_terms(side, a) for side in sides]
        for b in range(a, len(kept), block):
            joint = [(x.T @ of_terms(side, b)).astype(np.float64) for x, side in zip(left, sides)]
            good = ratio_of(joint, size) - np.maximum(own[a : a + block, None], own[b : b + block]) >= least
            out[b : b + block] |= good.any(0)
            out[a : a + block] |= good.any(1)
    return kept[out]


def presence(rows: list[np.ndarray], place: np.ndarray, n: int, chunk: int = 256) -> np.ndarray:
    """Bits of which of n terms each row has: eight rows a byte, a column a term."""
    packed = []
    for a in range(0, len(rows), chunk):
        part = np.zeros((len(rows[a : a + chunk]), n), bool)
        for k, at in enumerate(rows[a : a + chunk]):
            at = place[at]
            part[k, at[at >= 0]] = True
        packed.append(np.packbits(part, axis=0))
    return np.concatenate(packed)


def _score(model, column: str):
    def run(batches):
        machine = model.value
        for batch in sliced(batches):
            at, sizes = terms(batch.column("text"))
            ends = np.cumsum(sizes)
            raw = np.array([machine.raw(at[e - n : e]) for e, n in zip(ends, sizes)])
            score = pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, column])

    return run


#: From this score on a document counts as toxic.
REJECT = 0.7


def score(docs: DataFrame, machine: Machine) -> tuple[DataFrame, str]:
    """docs with their score in one more column, and its name: one pass, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    (column,) = unused(docs, "toxicity_score")
    return docs.mapInArrow(_score(shared, column), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])), column


def score_toxicity(docs: DataFrame, labels: DataFrame, fold_of: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: learned from labelled rows outside the held-out fold.

    Null and empty texts have no terms and get the bias's score. Without any label every
    score is low. Repeated rows are scored one by one; a repeated label counts once, 1 before 0.
    A null id is never held out.
    """
    machine = fit(docs, labels.where(fold(F.col("doc_id"), fold_of) != held), **options)
    docs = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found, column = score(docs, machine)
    return found.withColumnRenamed(column, "score").select("doc_id", F.coalesce(fold(F.col("doc_id"), fold_of) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_toxic(docs: DataFrame, labels: DataFrame, fold_of: int = 3, held: int = 1, **options) -> DataFrame:
    """The documents that are not predicted toxic, columns as given.

    Null and empty texts get the bias's score, which is low. Repeated rows and rows without id are judged one by
    one. Other columns, whatever their names, are carried along. Without labels nothing goes; an empty table
    stays empty.
    """
    machine = fit(docs, labels.where(fold(F.col("doc_id"), fold_of) != held), **options)
    found, column = score(docs, machine)
    return found.where(F.col(column) < REJECT).drop(column)
