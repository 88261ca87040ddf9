"""Best-fit packing: every token once, few sequences, ids equal to the tokenizer's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import pattern_packing
from parley.llm.pattern_packing import Plan, least_squares, pack_patterns, patterns

from .test_llm import DATA, data, docs, edge_texts


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(texts, window):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(vocabulary()), []
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), window)):
            own = ids[start : start + window]
            out.append((doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def check(rows, texts, window):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(brute_pieces(texts, window), key=key)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(filled)


@pytest.mark.parametrize("window", [7, 64, 4096])
def test_pieces_against_brute_force(spark, window):
    texts = [*edge_texts(), "It's <|endoftext|> x<|startoftext|>y", "ÀÉ ÿ. İstanbul ΟΔΟΣ ﬁ é ́ a b c\r\nd 12,5 ...?! l'été", "I'm 'S we'VE", "\x1c\x85a\x0b"]
    check(pack_patterns(docs(spark, *texts), vocabulary(), window=window).collect(), list(enumerate(texts)), window)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    assert check(pack_patterns(spark.createDataFrame(rows, "doc_id int, text string"), vocabulary()).collect(), rows, 4096) == 1


def test_empty_table(spark):
    assert pack_patterns(spark.createDataFrame([], "doc_id long, text string, piece int, part int"), vocabulary()).collect() == []


@data
def test_packs_the_table_tightly(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    found = pattern_packing.op13_best_fit_packing(spark, DATA).collect()
    sequences = check(found, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], 4096)
    assert sequences <= 1.02 * sum(r.length for r in found) / 4096 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    r = np.random.default_rng(seed)
    window = int(r.choice([5, 40, 512]))
    sizes = [r.integers(1, window + 1, 3000), np.full(500, window), np.minimum(window, r.geometric(8 / window, 4000)), np.full(999, max(1, window // 2 + 1)), np.array([1]), r.integers(window // 3, window // 2 + 1, 2000)][seed]
    histogram = np.bincount(sizes, minlength=window + 1)
    plan = Plan(histogram, bins=32)
    sizes, numbers = np.repeat(np.arange(window + 1), histogram), np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.places(sizes, numbers)
    order = np.lexsort((offset, sequence))
    same = np.append(False, np.diff(sequence[order]) == 0)
    assert (offset[order] == np.where(same, np.append(0, (offset + sizes)[order][:-1]), 0)).all()
    filled = np.bincount(sequence, sizes)
    assert filled.max() <= window and filled.min() > 0 and len(filled) == plan.sequences
    # no two sequences would fit into one
    low = np.sort(filled)[:2]
    assert len(low) < 2 or low.sum() > window
    # over a half each is alone, over a third two at most share a window
    assert plan.sequences <= 1.05 * max(filled.sum() / window, (sizes > window // 2).sum(), (sizes > window // 3).sum() / 2) + 2


def test_plan_is_small_for_many_documents():
    histogram = np.bincount(np.minimum(4096, np.random.default_rng(1).lognormal(6.3, 1, 200_000).astype(int) + 1), minlength=4097)
    small, large = Plan(histogram), Plan(histogram * 10_000)
    assert large.sequences <= 1.002 * (histogram * 10_000 * np.arange(4097)).sum() / 4096
    assert len(large.size) < 60_000 and len(small.size) < 60_000


def test_patterns_are_all_of_the_few():
    def brute(total, few, largest):
        return 1 if not total else sum(brute(total - k, few - 1, k) for k in range(1, min(total, largest) + 1)) if few else 0

    for bins, few in ((1, 3), (8, 1), (12, 3), (16, 4)):
        columns = patterns(bins, few)
        assert (np.arange(1, bins + 1) @ columns == bins).all() and columns.sum(0).max() <= few
        assert columns.shape[1] == len({tuple(c) for c in columns.T}) == brute(bins, few, bins)


def test_least_squares_meets_its_optimality_conditions():
    r = np.random.default_rng(5)
    for _ in range(10):
        a, b = r.normal(size=(12, 30)), r.normal(size=12)
        x = least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_memory_of_parts_is_bounded():
    encoder = pattern_packing.WordEndTokenizer(vocabulary(), most=10)
    r = random.Random(3)
    texts = [" ".join(f"{chr(97 + r.randrange(26))}x{r.randrange(1000)}" for _ in range(50)) for _ in range(5)]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids
