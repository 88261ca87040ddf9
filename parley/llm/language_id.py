"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of the lower-cased text are hashed into a fixed number of buckets.
Document frequencies are counted over all training documents by Spark. Weights are
learned by follow-the-regularised-leader with elastic-net penalties on a bounded
sample (`sample_per_lang` documents a language, in expectation, chosen by a hash of the id);
a tenth of that sample is kept aside to fit one temperature, so that the score
is a calibrated probability. Scoring is one pass over the documents with no shuffle.
The model is a dense array of fixed size: buckets x languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, give_back, lists, sliced, table, text_rows, unused

BITS = 15
LETTER = regex.compile(r"\p{L}")
STEPS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def grams(text: str | None, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's character n-grams, n from 1 to n_max."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    counts, h = np.zeros(1 << BITS, np.int64), np.zeros(len(points), np.uint32)
    for n in range(1, n_max + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint32(n)) * STEPS[n % 3]
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * STEPS[0]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def _frequencies(n_max: int):
    def run(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[grams(text.as_py(), n_max)[0]] += 1
        at = np.flatnonzero(total)
        yield table({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    return run


def _features(n_max: int):
    def run(batches):
        for batch in sliced(batches):
            got = [grams(t, n_max) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(a) for a, _ in got])
            yield table({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "at": lists(np.concatenate([a for a, _ in got]), sizes, pa.int32()), "counts": lists(np.concatenate([c for _, c in got]), sizes, pa.int32())})

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Per-coordinate FTRL-proximal; the last row of the weights is the bias."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, 1 << BITS), np.append(x, 0.1)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return weights(z, n)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least held-out log loss."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 5, 80)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, n_max: int = 3, sample_per_lang: int = 600) -> dict:
    """Learn from the rows of docs (doc_id, text, lang) with a language. The model: langs, idf, weights, temperature."""
    docs = text_rows(docs, "doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return {"langs": []}
    found = docs.select("text").mapInArrow(_frequencies(n_max), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_lang / n))).otherwise(share)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    rows = docs.where(dice < share).mapInArrow(_features(n_max), "doc_id long, lang string, at array<int>, counts array<int>").toArrow()
    langs = sorted(sizes)
    # buckets are views of the table's own
    ats, counts = (rows.column(c).combine_chunks() for c in ("at", "counts"))
    ends, flat, counted = ats.offsets.to_numpy(), ats.values.to_numpy(), counts.values.to_numpy()
    spoken = rows.column("lang").to_pylist()
    data = []
    for k in np.argsort(rows.column("doc_id").to_numpy(), kind="stable").tolist():
        if ends[k + 1] > ends[k]:
            at = flat[ends[k] : ends[k + 1]]
            data.append((at, weigh(at, counted[ends[k] : ends[k + 1]], idf), langs.index(spoken[k])))
    del rows, counts, counted
    learn, aside = [r for k, r in enumerate(data) if k % 10], data[::10]
    w = ftrl(learn, len(langs)) if learn else np.zeros(((1 << BITS) + 1, len(langs)))
    logits = np.array([x @ w[at] + 0.1 * w[-1] for at, x, _ in aside]).reshape(-1, len(langs))
    model = {"langs": langs, "idf": idf, "weights": w, "temperature": temperature(logits, np.array([y for *_, y in aside], int)), "n_max": n_max}
    del ats, flat, data, learn, aside
    give_back()
    return model


def _predict(model, columns: list[str]):
    def run(batches):
        m = model.value
        langs, idf, w = m["langs"], m.get("idf"), m.get("weights")
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not langs or not text or not LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at, counts = grams(text, m["n_max"])
                p = softmax((weigh(at, counts, idf) @ w[at] + 0.1 * w[-1]) / m["temperature"])
                best = int(p.argmax())
                names.append(langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *columns])

    return run


def predict(docs: DataFrame, model: dict) -> tuple[DataFrame, str, str]:
    """docs with two more columns in one pass, and the names of those: language and score. `und` with score 0 if there is no letter or no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang, score = unused(docs, "language_predicted", "language_score")
    return docs.mapInArrow(_predict(shared, [lang, score]), T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])), lang, score


def identify_languages(docs: DataFrame, fold_of: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents outside the held-out fold.

    Null or letterless texts are `und` with score 0; so is everything if no document
    has a language. Letters are those of Unicode's category L. Repeated rows are scored one by one. A null
    id is never held out and never learned from. Other columns don't matter. An empty table gives no rows.
    """
    part = fold(F.col("doc_id"), fold_of)
    model = fit(docs.where(part != held), **options)
    docs = text_rows(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found, lang, score = predict(docs, model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), fold_of) == held, F.lit(False)).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.3


def with_known_language(docs: DataFrame, least: float = LEAST_SCORE, fold_of: int = 5, held: int = 0, **options) -> DataFrame:
    """The documents with a recognised language, columns as given. `und` and unsure ones go.

    So null, empty and letterless texts go. Repeated rows and rows without id are judged one by one. Other
    columns, whatever their names, are carried along. Without any known language every document goes; an
    empty table stays empty.
    """
    model = fit(docs.where(fold(F.col("doc_id"), fold_of) != held), **options)
    found, lang, score = predict(docs, model)
    return found.where((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)
