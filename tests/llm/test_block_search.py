"""Ranked search against brute force; blocks are skipped and nothing is lost."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import block_search
from parley.llm.block_search import Shard, Vocabulary, ranked_documents, terms_of

from .test_llm import docs, edge_texts, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(texts, items, k=20):
    counts = {i: Counter(split(t)) for i, t in texts if split(t)}
    n, total = len(counts), sum(sum(c.values()) for c in counts.values())
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts.items():
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(split(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


ITEMS = "item_id int, text string, rank string, score string, doc_id int"


def items(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in enumerate(texts)], ITEMS)


def corpus(n, seed, vocabulary=300, length=40):
    r = random.Random(seed)
    return [" ".join(f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(r.randrange(1, length))) for _ in range(n)]


@pytest.mark.parametrize(("cells", "block"), [(1 << 23, 64), (1, 4)])
def test_ranking_against_brute_force(spark, cells, block):
    texts = [*corpus(400, 1), *edge_texts(), "Ünïcödé-word W1 w1", "w1 " * 3000, *["w5 w6 w7"] * 40, "a_b a`b w9\x7fw9"]
    asked = ["w1 w2 w3 w1", "w5 w6 w7", None, "", "!!!", "nowhere", "ÜNÏCÖDÉ ünïcödé", *corpus(30, 2, length=30), "same w1 é", "w0 " * 500]
    got = found(ranked_documents(docs(spark, *texts).repartition(3), items(spark, *asked), cells=cells, block=block))
    assert got == sorted(brute(list(enumerate(texts)), list(enumerate(asked))))


def test_blocks_of_items(spark):
    texts, asked = corpus(150, 3), corpus(20, 4)
    got = found(ranked_documents(docs(spark, *texts), items(spark, *asked), k=5, block_bytes=200))
    assert got == sorted(brute(list(enumerate(texts)), list(enumerate(asked)), 5))


def test_missing_and_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a c"), (None, "a a a"), (2, "b")]
    asked = spark.createDataFrame([(7, "b"), (7, "a"), (None, "c")], "item_id long, text string")
    got = ranked_documents(spark.createDataFrame(rows, "doc_id long, text string"), asked).collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(7, 1, 1), (7, 2, 1)]


def test_empty_tables(spark):
    none, some = docs(spark).limit(0), docs(spark, "a", None)
    assert ranked_documents(none, items(spark, "a")).collect() == []
    assert ranked_documents(some, items(spark, "a").limit(0)).collect() == []
    assert ranked_documents(docs(spark, None, "", "..."), items(spark, "a")).collect() == []


def test_terms_are_found_byte_by_byte():
    known = Vocabulary([b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghX", "é".encode(), b"x" * 100])
    column = pa.array(["a AB abcdefgh abcdefghx", None, "ABCDEFGHI abcdefghj é É " + "x" * 100, "x" * 101])
    at, term = known.find(terms_of(column))
    spelled = [w for t in column.to_pylist() for w in split(t)]
    assert [(spelled[a].encode(), known.terms[t]) for a, t in zip(at, term)] == [(w.encode(), w.encode()) for w in spelled if w.encode() in known.terms]
    assert [len(x) for x in Vocabulary([]).find(terms_of(column))] == [0, 0]


def test_equal_hashes_are_told_apart(monkeypatch):
    real = block_search.spans_hash
    monkeypatch.setattr(block_search, "spans_hash", lambda raw, a, b, seed: real(raw, a, b, seed) & np.uint64(31 if seed < block_search.BYTES + 3 else 255))
    known = Vocabulary([f"t{k}".encode() for k in range(6)])
    at, _ = known.find(terms_of(pa.array([" ".join(f"t{k}" for k in range(500))])))
    assert at.tolist() == list(range(6))


def test_blocks_are_skipped_and_bounds_hold():
    r = np.random.default_rng(3)
    n, terms, topics = 2000, 200, 20
    rows = [np.unique(np.append(r.integers(0, 10, 6) + 10 * r.integers(0, topics), r.integers(0, terms, 3))) for _ in range(n)]
    values = [1 + (1_000_000 * r.random() ** 3 * r.random(len(x)) ** 2).astype(np.int64) for x in rows]
    shard = Shard(np.arange(n), np.array([len(x) for x in rows]), np.concatenate(rows), np.concatenate(values), np.ones(terms, np.int64), 8)
    for b in range(len(shard.summary)):
        assert (shard.summary[b] == shard.values[shard.rows[shard.bounds[b] : shard.bounds[b + 1]]].max(axis=0)).all()
    for t in range(terms):  # every posting is in exactly one block of its term
        own = shard.rows[shard.bounds[shard.first[t]] : shard.bounds[shard.first[t + 1]]]
        assert sorted(own.tolist()) == np.flatnonzero(shard.values[:, t]).tolist()
    visited = total = 0
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q in range(40):
        query, weights = 10 * (q % topics) + np.arange(5), r.integers(1, 9000, 5)
        (scores, ids), blocks, seen = shard.search(query, weights, none, 10)
        whole = shard.values[:, query].astype(np.int64) @ weights
        order = np.lexsort((np.arange(n), -whole))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        visited, total = visited + seen, total + blocks
    assert visited < 0.75 * total
