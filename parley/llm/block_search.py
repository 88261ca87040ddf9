"""Ranked lexical search over an inverted index whose posting lists are blocked geometrically.

1. Count. Documents become rows of their length and their frequencies of the queries' terms; the number
   of documents, their terms with repeats and each term's document frequency count all documents.
2. Index. A task's rows are indexed in shards of a bounded number of documents. A term's posting list is clustered
   by the similarity of its documents: those nearest to the same one of evenly drawn members are a block,
   and a block's summary is the coordinatewise maximum of its documents' weights.
3. Search. A query's blocks, of all its terms, are visited by falling bound: the inner product
   of query and summary, which no document in the block can exceed. Blocks are skipped once that bound is
   below the k-th best score so far, which a task carries on from shard to shard. So the result is exact.
4. Merge the tasks' k best of each query.

All scores are whole numbers. Queries are taken in blocks of bounded size, each of which is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES, LOW, SEPARATOR, Words, scratch, sliced, spans_hash, staged, table, text_rows

#: Bytes that are no part of a term: all of ASCII but digits and letters.
OUTSIDE = np.ones_like(SEPARATOR)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(column: pa.Array) -> Words:
    """The terms of each row: runs of ASCII digits and letters and of any other characters beyond ASCII, A-Z as a-z."""
    return Words(column, lower=True, separator=OUTSIDE)


class Vocabulary:
    """Finds terms among known ones, by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms, self.seed = sorted(set(terms)), BYTES
        sizes = np.array([len(t) for t in self.terms], np.int64)
        raw, ends = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(sizes)
        hashes = spans_hash(raw, ends - sizes, ends, self.seed)
        while len(np.unique(hashes)) < len(hashes):
            self.seed += 1
            hashes = spans_hash(raw, ends - sizes, ends, self.seed)
        self.order = np.argsort(hashes)
        self.hashes, self.sizes, self.begins, self.raw = hashes[self.order], sizes, ends - sizes, raw
        self.low = np.zeros(1 << 16, bool)
        self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and the number of the term that each of those is."""
        if not len(self) or not len(words.bytes_from):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = spans_hash(words.raw, words.bytes_from, words.bytes_to, self.seed)
        at = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self) - 1)
        term = self.order[place]
        same = (self.hashes[place] == hashes[at]) & (self.sizes[term] == (words.bytes_to - words.bytes_from)[at])
        at, term = at[same], term[same]
        mine, theirs = (np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,)) for raw in (words.raw, self.raw))
        same, left = np.ones(len(at), bool), np.arange(len(at))
        for k in range(0, int(self.sizes.max()), 8):
            left = left[self.sizes[term[left]] > k]
            if not len(left):
                break
            mask = LOW[np.minimum(self.sizes[term[left]] - k, 8)]
            same[left] &= (mine[words.bytes_from[at[left]] + k] & mask) == (theirs[self.begins[term[left]] + k] & mask)
        return at[same], term[same]


class Shard:
    """Some documents' weights, each term's posting list in blocks, and the blocks' summaries.

    rows: each document's terms (numbers, each once) and their weights, whole numbers from 1 on; scale: the terms' weights, by which
    similarity is told. block: about how many documents a block has.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray, block: int):
        self.ids, n = ids, len(ids)
        row = np.repeat(np.arange(n), counts)
        self.values = np.zeros((n, len(scale)), np.int64 if values.max(initial=0) >= 1 << 31 else np.int32)
        self.values[row, terms] = values
        near = self._near(scale)
        order = np.argsort(terms, kind="stable")
        held, firsts = np.unique(terms[order], return_index=True)
        lists, starts, self.first = [], [], np.zeros(len(scale) + 1, np.int64)
        blocks, at = np.zeros(len(scale), np.int64), 0
        for term, rows in zip(held.tolist(), np.split(row[order], firsts[1:])):
            groups = -(-len(rows) // block)
            own = [0]
            if groups > 1:
                leaders = rows[(np.arange(groups) * len(rows)) // groups]
                nearest = np.argmax(near[rows[:, None], leaders], axis=1)
                by = np.argsort(nearest, kind="stable")
                rows, nearest = rows[by], nearest[by]
                own = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
            lists.append(rows)
            starts.append(np.asarray(own) + at)
            blocks[term], at = len(own), at + len(rows)
        np.cumsum(blocks, out=self.first[1:])
        self.rows = np.concatenate([np.zeros(0, np.int64), *lists])
        begins = np.concatenate([np.zeros(0, np.int64), *starts])
        self.bounds = np.append(begins, at)
        self.summary = np.zeros((len(begins), len(scale)), self.values.dtype)
        for k, (a, b) in enumerate(zip(self.bounds.tolist(), self.bounds[1:].tolist())):
            self.values[self.rows[a:b]].max(axis=0, out=self.summary[k])

    def _near(self, scale: np.ndarray, width: int = 64) -> np.ndarray:
        """Cosines of each two documents, about, by a random projection."""
        directions = np.random.default_rng(7).standard_normal((len(scale), width), np.float32) * scale[:, None].astype(np.float32)
        sketch = self.values.astype(np.float32) @ directions
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)
        return sketch @ sketch.T

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, step: int = 8) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
        """The k best (scores, ids) of this shard's documents and those in best; how many blocks the query has, and how many were visited."""
        blocks = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.first[t], self.first[t + 1]) for t in terms)])
        bounds = self.summary[blocks[:, None], terms].astype(np.int64) @ weights
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        seen, visited = np.zeros(len(self.ids), bool), 0
        while visited < len(blocks):
            least = max(1, int(best[0][-1])) if len(best[0]) >= k else 1
            # bounds fall, so what is skipped here is skipped for good
            to = visited + int(np.searchsorted(-bounds[visited : visited + step], -least, "right"))
            if to == visited:
                break
            rows = np.unique(np.concatenate([self.rows[self.bounds[b] : self.bounds[b + 1]] for b in blocks[visited:to]]))
            rows, visited, step = rows[~seen[rows]], to, step * 2
            seen[rows] = True
            best = merged(best, self.values[rows[:, None], terms].astype(np.int64) @ weights, self.ids[rows], least, k)
        return best, len(blocks), visited


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of both, from `least` on, with their ids; equal scores by ascending id."""
    good = scores >= least
    scores, ids = np.concatenate([best[0], scores[good]]), np.concatenate([best[1], ids[good]])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _documents(shared):
    """doc_id, n: a document's number of terms; the known ones of them and how often each occurs, as 32-bit numbers."""

    def run(batches):
        vocabulary = shared.value
        for batch in sliced(batches):
            words = terms_of(batch.column("text"))
            at, term = vocabulary.find(words)
            keys, counts = np.unique(words.row_of()[at] * max(1, len(vocabulary)) + term, return_counts=True)
            rows, term = np.divmod(keys, max(1, len(vocabulary)))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).tolist()
            terms, tf = term.astype("<i4"), counts.astype("<i4")
            yield table({
                "doc_id": batch.column("doc_id"), "n": pa.array(words.counts, pa.int64()),
                "terms": pa.array([terms[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), "tf": pa.array([tf[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            })

    return run


def _joined(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each has."""
    raw = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), "<i4"), np.array([len(r) // 4 for r in raw], np.int64)


def _frequencies(vocabulary: int):
    """How many documents of the partition have each term."""

    def run(batches):
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            df += np.bincount(_joined(batch, "terms")[0], minlength=vocabulary)
        held = np.flatnonzero(df)
        yield table({"term": pa.array(held, pa.int64()), "df": pa.array(df[held], pa.int64())})

    return run


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _shards(batches: Iterator[pa.RecordBatch], documents: int, all_documents: int, all_terms: int):
    """Arrays of a bounded number of documents that have any of the terms: ids, numbers of terms, terms and weights."""

    def done():
        return tuple(np.concatenate(part) for part in zip(*held))

    held, size = [], 0
    for batch in batches:
        for own in (batch.slice(a, documents) for a in range(0, batch.num_rows, documents)):
            if size and size + own.num_rows > documents:
                yield done()
                held, size = [], 0
            terms, counts = _joined(own, "terms")
            tf, length = _joined(own, "tf")[0].astype(np.int64), own.column("n").to_numpy()
            m = 100 - 25 + 25 * length * all_documents // max(1, all_terms)
            some = counts > 0
            held.append((own.column("doc_id").to_numpy()[some], counts[some], terms.astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, counts))))
            size += own.num_rows
    if size:
        yield done()


def _search(shared, n: int, total: int, k: int, documents: int, block: int):
    def run(batches):
        queries, scale = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        for ids, counts, terms, values in _shards(batches, documents, n, total):
            if len(ids):
                shard = Shard(ids, counts, terms, values, scale, block)
                for q, (_, own, weights) in enumerate(queries):
                    best[q], *_ = shard.search(own, weights, best[q], k)
        sizes = [len(scores) for scores, _ in best]
        items = np.repeat(np.array([item for item, *_ in queries], np.int64), sizes)
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *(b[j] for b in best)]) for j in (0, 1))
        yield table({"item_id": pa.array(items), "doc_id": pa.array(ids), "score": pa.array(scores)})

    return run


RESULT = "item_id long, rank int, doc_id long, score long"


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 64, block_bytes: int = 1 << 17, cells: int = 1 << 23) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item's text.

    Documents' ids and texts are `doc_id` and `text`, items' `item_id` and `text`; other columns don't matter. Equal scores go by
    ascending doc_id. Null and empty texts have no terms: such documents don't count, such items have no
    rows. Rows without an id take no part. Documents that share an id are ranked one by one; items that
    share an id are one item, with the least text. An empty table on either side gives no rows.

    Items are dealt over blocks of about block_bytes of text; `cells` bounds documents times terms of a shard.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    docs = text_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = text_rows(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toPandas()
        part = _one_block(docs, own, f"{folder}/{b}", k, block, cells)
        found = part if found is None or part is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], RESULT)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_block(docs: DataFrame, items, folder: str, k: int, block: int, cells: int) -> DataFrame:
    """item_id, doc_id, score: among them each item's k best."""
    spark = docs.sparkSession
    words = terms_of(pa.array(items["text"].tolist(), pa.string()))
    raw = words.raw.tobytes()
    spelled = [raw[a:b] for a, b in zip(words.bytes_from.tolist(), words.bytes_to.tolist())]
    vocabulary = Vocabulary(spelled)
    rows = staged(docs.mapInArrow(_documents(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms binary, tf binary").where("n > 0"), folder, "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # at most a row for each term of the items
    counted = rows.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[counted["term"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    weights = np.array([term_weight(n, d) for d in df.tolist()], np.int64)
    number = {t: j for j, t in enumerate(vocabulary.terms)}
    queries = []
    for item, a, b in zip(items["item_id"].tolist(), words.offsets.tolist(), words.offsets[1:].tolist()):
        own, repeats = np.unique([number[t] for t in spelled[a:b]], return_counts=True)
        if len(own):
            queries.append((item, own.astype(np.int64), weights[own.astype(np.int64)] * repeats))
    documents = max(64, min(4096, cells // max(1, len(vocabulary))))
    shared = spark.sparkContext.broadcast((queries, weights))
    return rows.mapInArrow(_search(shared, n, total, k, documents, block), "item_id long, doc_id long, score long")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of all for each benchmark item."""
    return ranked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE doc_id IS NOT NULL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY item_id, term)
  JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
