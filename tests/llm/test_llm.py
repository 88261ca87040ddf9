"""The training-data operators against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import chat_format, jaccard_join, language_id, near_vectors, packing, sentencepiece_codec, substring_dedup, topk_search, toxicity, warc_index
from parley.llm.common import WORD, Words

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
DOCS = "doc_id long, text string, lang string, key long, score double, shard string"


def docs(spark, *texts, start=0):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(start + i, t, "en", 1, 0.5, "x") for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=10_000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_texts():
    long = " ".join(words(30_000, 1))
    return [None, "", "   \t\n", "a", "a", "é" * 5000, long, long, "same same same " * 60, "x y \x0bz", "🙂 \x00"]


def brute_repeats(texts, window):
    split = [re.findall(WORD, t or "") for t in texts]
    first = {}
    for i, w in enumerate(split):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    base, shared = words(300, 2), words(70, 3)
    texts = [" ".join(base), " ".join(words(80, 4) + shared + words(90, 5)), " ".join(base[:120] + ["changed"] + base[121:]), "\n".join(words(40, 6) + shared + shared), " ".join(base), " ".join(base[50:99]), " ".join(base[50:100]), *edge_texts()]
    for k in range(8):  # near copies of each other
        copy = list(base)
        copy[random.Random(k).randrange(300)] = f"edit{k % 3}"
        texts.append(" ".join(copy))
    got = substring_dedup.remove_repeats(docs(spark, *texts), window=50, shard_bytes=2000)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_repeats(texts, 50)
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, *texts)).collect()}
    assert kept[0] == texts[0] and 4 not in kept and kept[9] == "   \t\n"


def thue_morse(n):
    """Two sequences of a and b whose weighted sums agree for every odd base modulo a power of two."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_regular_texts_do_not_collide(spark):
    one, two = thue_morse(1024)
    texts = [one, two, " ".join(one), " ".join(two)]
    assert [r.component_id for r in jaccard_join.similar_documents(docs(spark, one, two), k=3, num=90).orderBy("doc_id").collect()] == [0, 1]
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs(spark, *texts), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_repeats(texts, 50)
    hashed = Words(pa.array(texts))
    assert len(set(hashed.hash[:2].tolist())) == 2 and len(set(hashed.grams(1024)[[2, 1026]].tolist())) == 2


def test_rows_that_share_an_id_keep_their_own_words(spark):
    passage = words(60, 8)
    rows = [(1, " ".join(passage)), (5, " ".join(["x", *passage, "y"])), (5, "four other short words"), (5, "four other short words"), (None, " ".join(passage))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_gone", "kept", "sha", "done_id")})
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([(1, 60, 0, sha(rows[0][1])), (5, 62, 60, sha("x y")), *[(5, 4, 0, sha(rows[2][1]))] * 2, (None, 60, 0, sha(rows[0][1]))])
    left = substring_dedup.without_repeats(frame)
    assert left.columns == frame.columns and Counter(r.text for r in left.collect()) == Counter([rows[0][1], rows[0][1], "x y", rows[2][1], rows[2][1]])
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0 and substring_dedup.without_repeats(frame.limit(0)).count() == 0


def test_many_variants_of_a_passage(spark):
    """A third of the rows are near copies whose passages share nearly all of their half windows."""
    base, texts = words(160, 9), []
    for k in range(120):
        copy, r = list(base), random.Random(k)
        for _ in range(3):
            copy[r.randrange(160)] = f"edit{r.randrange(4)}"
        texts.append(" ".join(copy))
    got = substring_dedup.remove_repeats(docs(spark, *texts), window=50)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_repeats(texts, 50)


def brute_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "num", "frequent"), [(3, 90, 16), (3, 90, 1), (5, 80, 2), (2, 50, 4)])
def test_jaccard_join_against_brute_force(spark, k, num, frequent):
    r, texts = random.Random(num), [*edge_texts(), "A b C", "a B c", "a b"]
    for family in range(4):
        base = words(60 + 40 * family, family, 300)
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(5)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = [f"e{r.randrange(6)}"]
            texts.append(" ".join(copy))
    got = jaccard_join.similar_documents(docs(spark, *texts), k=k, num=num, frequent=frequent)
    assert sorted(map(tuple, got.collect())) == brute_groups(texts, k, num, 100)


def test_combinations_lose_no_pair():
    """Any two sets above the threshold share a key, whatever the counts of their tokens."""
    r = np.random.default_rng(1)
    for _ in range(300):
        n, t = int(r.integers(9, 120)), int(r.choice([75, 80, 90, 95]))
        pool = r.choice(10_000, 2 * n, replace=False).astype(np.int64)
        x = set(pool[:n].tolist())
        y = set(x)
        while True:
            z = set(y)
            (z.discard if r.random() < 0.5 else z.add)(int(r.choice(pool)))
            if 100 * len(x & z) < t * len(x | z):
                break
            y = z
            if r.random() < 0.05:
                break
        counts = {int(p): int(r.choice([2, 3, 50, 900])) for p in pool}
        found = [jaccard_join.signatures(len(s), np.array(sorted(s)), np.array([counts[p] for p in sorted(s)]), t, 100, 16) for s in (x, y)]
        possible = (100 + t) * min(f[3] for f in found) >= t * (len(x) + len(y))
        assert x == y or set(found[0][0].tolist()) & set(found[1][0].tolist()) or (possible and set(found[0][1].tolist()) & set(found[1][1].tolist()))


def test_language_edges_and_learning(spark):
    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "of", "that"] if i % 2 else ["der", "und", "nicht", "für"], k=30)), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200, None, None), (201, "", "en"), (202, "12 34 !", "de"), (204, "½ ² ³ Ⅷ ①", None), (203, "der " * 40_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify_languages(frame).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(120)) and got[203].lang_pred == "de"
    assert {got[i].lang_pred for i in (200, 201, 202, 204)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert {i for i in range(120) if got[i].held_out} == {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    none = language_id.identify_languages(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify_languages(frame.limit(0)).count() == 0
    clash = frame.withColumns({c: F.lit("x") for c in ("language_predicted", "Language_Score")})
    kept = language_id.with_known_language(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {*range(120), 203}
    assert language_id.with_known_language(frame.limit(0)).count() == 0


def test_factorization_machine_learns_a_pair():
    """Two terms that mean nothing alone and much together: beyond any sum of weights."""
    machine, r = toxicity.Machine(), np.random.default_rng(0)
    rows = [(np.array([1] * a + [2] * b + [int(x) for x in r.choice(np.arange(10, 40), 4, replace=False)]), int(a == b)) for _ in range(150) for a in (0, 1) for b in (0, 1)]
    machine.known[:40] = True
    machine.learn(rows, epochs=60)
    right = np.mean([(machine.raw(at) > 0) == y for at, y in rows])
    assert right > 0.95


def test_fit_learns_a_pair(spark):
    """fit() keeps terms that are as frequent in either class, and learns that they count together."""
    r, texts, marks = random.Random(0), [], []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        texts.append(" ".join(["qa"] * a + ["qb"] * b + [f"n{x}" for x in r.sample(range(30), 4)]))
        marks.append((k, int(a == b)))
    machine = toxicity.fit(docs(spark, *texts), spark.createDataFrame(marks, "doc_id long, toxic int"))
    rows = toxicity.score(docs(spark, *texts), machine)[0].toPandas().sort_values("doc_id")
    assert np.mean((rows.toxicity_score > 0.5) == np.array([y for _, y in marks])) > 0.95


@data
def test_toxicity_on_held_out_rows_and_edges(spark):
    found = toxicity.score_toxicity(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    caught = rows[rows.toxic == 1].predicted.mean()
    assert caught > 0.75 and rows[rows.toxic == 0].predicted.mean() < 0.01
    frame = docs(spark, *edge_texts())
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(frame, empty).collect()} == {0}
    assert toxicity.without_toxic(frame, empty).collect() == frame.collect()
    clash = frame.withColumns({c: F.lit("x") for c in ("toxicity_score", "at", "toxic")})
    assert toxicity.without_toxic(clash, empty).collect() == clash.collect()
    assert toxicity.score_toxicity(frame.limit(0), empty).count() == 0 and toxicity.without_toxic(frame.limit(0), empty).count() == 0


@data
def test_packing_holds_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*edge_texts(), "<|endoftext|> it's ½ Ⅷ x\x1cy", "<|endoftext|> hi", *[" ".join(words(400, k)) for k in range(30)]]
    rows = packing.pack_documents(docs(spark, *texts).withColumns({c: F.lit("clash") for c in ("ids", "r0", "kind")}), shard_tokens=4000).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode("<|endoftext|> hi", add_special_tokens=False).ids == [50256, 23105]
    for i, t in enumerate(texts):
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in rows[rows.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    short = 0
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length).tolist()[:-1]]
        total = int(s.length.sum())
        assert total <= 2048 and total & (total - 1) == 0
        short += total < 2048
    assert short <= 11 * 4
    assert packing.pack_documents(docs(spark, "a").limit(0)).count() == 0
    assert packing.pack_documents(docs(spark, None, None)).toPandas()[["length", "doc_tokens"]].values.tolist() == [[1, 1], [1, 1]]


def brute_chain(documents, window):
    """Greedy packing by plain BM25 over all terms of the seed, as a dictionary of scores."""
    n, mean = len(documents), np.mean([len(d) for d in documents])
    counts = [Counter(d.tolist()) for d in documents]
    df = Counter(t for c in counts for t in c)

    def score(seed, other):
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[other][t] * 2.2 / (counts[other][t] + 1.2 * (0.25 + 0.75 * len(documents[other]) / mean)) for t in counts[seed] if t in counts[other])

    order, left, seed, filled = [], list(range(n)), None, 0
    while left:
        if seed is None:
            seed = left.pop(0)
            order.append(seed)
            filled = (filled + len(documents[seed])) % window
        near = sorted((k for k in left if score(seed, k) > 0), key=lambda k: (-score(seed, k), k))
        seed = None
        for k in near:
            left.remove(k)
            order.append(k)
            filled += len(documents[k])
            if filled >= window:
                filled %= window
                seed = k
                break
    return order


def test_chain_against_brute_force():
    r = np.random.default_rng(3)
    documents = [r.integers(0, 400, int(r.integers(5, 90))).astype(np.uint32) for _ in range(60)]
    assert packing.chain(documents, packing.corpus_of(documents), 256, 1000) == brute_chain(documents, 256)


def first_words(rows):
    """The documents in the order in which they are packed."""
    return [int(i) for i in rows[rows.start == 0].sort_values(["sequence_id", "offset"]).doc_id]


@data
def test_packing_is_greedy_within_a_shard(spark):
    import public_tokenizers

    texts = [" ".join(words(60, k, 40)) for k in range(30)]
    encoder = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    documents = [np.append(e, np.uint32(packing.END_ID)) for e in encoder.encode(texts)]
    rows = packing.pack_documents(docs(spark, *texts).coalesce(1), window=512).toPandas()
    got, corpus = first_words(rows), packing.corpus_of(documents)
    parts = [[i for i in got if i in set(rows[rows.sequence_id // (1 << 32) == p].doc_id)] for p in sorted(set(rows.sequence_id // (1 << 32)))]
    for part in parts:  # one shard a partition, in the order of the telling terms
        own = sorted(part, key=lambda i: tuple(corpus.telling(documents[i], 3)))
        assert [own[k] for k in packing.chain([documents[i] for i in own], corpus, 512, 24)] == part


@data
def test_packing_brings_partners_together(spark):
    """Partners of a topic of their own are spread over a corpus of many shards, and meet nonetheless."""
    alone = [" ".join(words(150, k, 60).copy() + [f"zq{k}topic{j}" for j in range(40)]) for k in range(100)]
    rows = packing.pack_documents(docs(spark, *alone, *alone), shard_tokens=10_000).toPandas()
    where = rows[rows.start == 0].sort_values(["sequence_id", "offset"]).reset_index(drop=True).doc_id % 100
    assert np.mean(where.to_numpy()[1:] == where.to_numpy()[:-1]) > 0.4


def test_further_terms_fill_the_window():
    """The seed's rarest terms lead to a used document only; the rest of its terms lead to a late one."""
    rare, common = np.arange(100, 124), np.arange(200, 260)
    documents = [np.array(x, np.uint32) for x in ([*rare, *common], rare, [1, 2], [3, 4], [*common, 5], [*common, 6])]
    assert packing.chain(documents, packing.corpus_of(documents), 1000, 24) == [0, 1, 4, 5, 2, 3]


def test_sentencepiece_parity_on_whole_texts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*edge_texts(), "  two  spaces ", "日本語 ﬁ", "a\tb\n\nc", "▁ mark", *[" ".join(words(200, k)) for k in range(5)]]
    assert sentencepiece_codec.encode_documents(docs(spark, "a").limit(0), path).count() == 0
    for r in sentencepiece_codec.encode_documents(docs(spark, *texts), path, with_ids=True).collect():
        assert r.ids == original.encode(texts[r.doc_id] or "") and r.parity
        assert r.round_trip == ("▁" not in (texts[r.doc_id] or ""))


def test_unigram_model_rebuilt_by_hand(tmp_path):
    """A model file put together field by field, read by both libraries."""
    import sentencepiece

    def field(number, kind, value):
        return bytes([number << 3 | kind] if number < 16 else [(number << 3 | kind) & 127 | 128, number << 3 >> 7]) + value

    def piece(text, score, kind=1):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("▁ab", -2, 1), ("a", -4, 1), ("b", -4.5, 1), ("ab", -3.2, 1), ("▁a", -3.1, 1), ("c", -5, 1), ("bc", -4.1, 1)]
    spec = field(3, 0, b"\x01") + field(40, 0, b"\x00") + field(41, 0, b"\x01") + field(42, 0, b"\x02")
    norm = field(1, 2, b"\x08identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01")
    raw = b"".join(piece(*p) for p in pieces) + field(2, 2, bytes([len(spec)]) + spec) + field(3, 2, bytes([len(norm)]) + norm)
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    original, mine = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    for text in ("abc ab", "  ab   c ", "cab", "", "bca abab"):
        (ids, back, parity), = mine.encode([text])
        assert ids.tolist() == original.encode(text) and back == original.decode(ids.tolist()) and parity


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("tile", F.lit("x"))


BAD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 0.0])]


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(240, 6)), 1).astype(np.float32)  # rounded: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[0].tolist()), *BAD]
    got = topk_search.top_k(vectors(spark, rows), F.col("id") % 20 == 0, k=7, tile_rows=30, block_rows=5, fan=3).collect()
    ids = np.array([*range(240), 1000])
    whole = np.floor(64 * np.vstack([x, x[:1]]).astype(float)).astype(int)
    for q in [*range(0, 240, 20), 1000]:
        score = whole @ whole[np.flatnonzero(ids == q)[0]]
        best = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:7]
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == best
    assert topk_search.top_k(vectors(spark, rows).limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_of_large_components(spark):
    big = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, 1.0]), (3, [3e30, 1.0]), (4, [-3e30, 0.0]), (5, [3e38, 1.0])]
    got = [(g.vec_id, g.score) for g in sorted(topk_search.top_k(vectors(spark, big), F.col("id") == 0, k=5).collect(), key=lambda g: g.rank)]
    x = [[int(64 * float(np.float32(c))) for c in v] for _, v in big]
    score = {i: max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(x[0], x[i])))) for i in range(1, 6)}
    assert got == sorted(score.items(), key=lambda s: (-s[1], s[0]))


def test_near_vectors_recall_and_edges(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(150, 32))
    near = np.vstack([base[k % 30] + r.normal(size=32) * 0.02 * (k % 12) for k in range(200)])
    hot = np.vstack([base[0] + r.normal(size=32) * 0.05 for _ in range(120)])
    x = np.vstack([base, near, hot, base[:5], base[:1] * 2]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(905, [0.0] * 32), *BAD]
    frame = vectors(spark, rows)
    tiny = near_vectors.near_vectors(spark.createDataFrame([(1, [1e-200] * 8), (2, [1e200] * 8), (3, [1e-200] * 7 + [-1.0])], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [tuple(r) for r in tiny] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0
    got = {g.vec_id: g for g in near_vectors.near_vectors(frame, most=40).collect()}
    unit = x.astype(float)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = close.sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert all(got[i].kept and got[i].n_links == 0 for i in range(900, 906)) and len(got) == len(rows)
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(close[i]))]) for i in range(len(x))]
        if new == label:
            break
        label = new
    assert np.mean([got[i].component_id == label[i] and got[i].kept == (label[i] == i) for i in range(len(x))]) > 0.99


def test_templates():
    run = lambda source, rows, **n: list(chat_format.compile_template(source)(rows, **n))
    assert run("{{ 'a' + 'b' }}{% if 1 == 2 %}x{% else %}y{% endif %}{# no #}", []) == [("aby", False)]
    assert chat_format.fold_tree(chat_format.parse("{{ 'a' | upper }}b")) == ("all", [("text", "Ab")])
    assert "".join(t for t, _ in run("{% for m in messages %}{% if loop.first %}<{% endif %}{{ m['role'] }}{% endfor %}", [{"role": "u"}, {"role": "a"}])) == "<ua"
    assert run("{{ m.__class__ }}", [], m={}) == [("", False)]
    for broken in ("{% for x %}{% endfor %}", "{% if 1 %}", "{{ a | system }}", "{{ 'x }}", "{{ (1 }}", "{% generation %}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(broken)
    for text in ("</s>[INST] ok [/INST]", "&#60;|end|>\n<|end|>\n", "a & b &#38; <|turn|>x", "[[INST]"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert all(c not in chat_format.escape(text) for c in chat_format.CONTROL)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|end|>\n"), (1, 1, "assistant", "[INST]&"), (1, None, None, None), (2, 0, "assistant", ""), (None, 0, "us\ner", "x"), (1, 1, "assistant", "[INST]&"), (3, 0, "assistant", "y" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    got = {r.conv_id: r for r in chat_format.format_conversations(frame).collect()}
    turns = "\n\n" + "user\nhi <|end|>\n\n" + "assistant\n[INST]&\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_sha256 == hashlib.sha256(b"[INST]&[INST]&").hexdigest() and got[1].loss_chars == 14
    assert got[None].turns_sha256 == hashlib.sha256(b"us\ner\nx\n").hexdigest() and got[2].loss_chars == 0 and got[3].loss_chars == 300_000
    assert got[1].formatted_chars == sum(len(r.piece) for r in chat_format.formatted_turns(frame).where("conv_id = 1").collect())
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_warc_round_trip_and_order(spark):
    pages = [(1, "http://b.org/x", "same"), (5, "http://a.b.org/x?b=2&a=1#f", "same"), (9, "https://www.a.org/", "same"), (3, None, None), (4, "http://a.org/é\r\nX: y", ""), (None, "http://c.org", "same"), (7, "http://a.org/", "z" * 2_000_000), (9, "https://www.a.org/", "same")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("owner", F.lit(1))
    rows = warc_index.archive_and_index(frame, file_bytes=500).collect()
    assert [(r.url_key, r.timestamp) for r in rows] == sorted((r.url_key, r.timestamp) for r in rows)
    digest = lambda t: warc_index.base32_sha1((t or "").encode())
    want = Counter((p, len((t or "").encode()), digest(t), *(("revisit", o) if o else ("response", None))) for (p, _, t), o in zip(pages, (9, 9, None, 4, None, None, None, None)))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    all_full = warc_index.archive_and_index(frame, least_bytes=5).collect()
    assert {r.record_type for r in all_full} == {"response"}
    assert warc_index.archive_and_index(frame.limit(0)).count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


@data
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, sizes = whole, [whole.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA).persist()
        assert rows.columns == whole.columns
        sizes.append(rows.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    toxic = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").join(whole, "doc_id")
    kept = corpus_pipeline.toxicity(spark, whole, DATA)
    assert toxic.join(kept, "doc_id", "left_anti").count() <= 0.02 * toxic.count()
    packed = corpus_pipeline.packing(spark, rows, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def colliding(n):
    """Words of 16 bytes whose hashes are equal under the public constants alone, without a key."""
    from parley.llm import common

    first = np.frombuffer("".join(f"{k:08x}" for k in range(2 * n)).encode(), np.uint8).reshape(-1, 8).view("<u8").ravel()
    h = common.mix(first ^ (np.uint64(16) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(common.BYTES))) * np.uint64(common.BYTES)
    a, b = h[:n], h[n:]
    return [(x.tobytes() + u.tobytes(), y.tobytes() + (u ^ p ^ q).tobytes()) for x, y, p, q, u in zip(first[:n], first[n:], a, b, np.full(n, np.uint64(0x6161616161616161)))]


def test_hashes_are_keyed():
    from parley.llm.common import spans_hash

    ends = np.array([16, 32])
    for left, right in colliding(20):
        raw = np.frombuffer(left + right, np.uint8)
        for key, same in ((0, True), (1, False), (0x1234567, False)):
            a, b = spans_hash(raw, ends - 16, ends, 0x5851F42D4C957F2D ^ key)
            assert (a == b) == same


#: fixed values: words that collide under the hash without a key
COLLIDING = ("dffxktqn!!!!!;!!", '1l5j414z1blo)["`')


def test_texts_of_colliding_words(spark):
    pairs = []
    for left, right in colliding(20_000):
        if all(byte >= 0x21 and byte < 0x7F for byte in right):
            pairs.append((left.decode(), right.decode()))
    pairs.append(COLLIDING)
    one, other = (" ".join(p[k] for p in pairs for _ in range(60)) for k in (0, 1))
    table = docs(spark, one, other, other)
    found = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(table).collect()}
    assert found == {0: 0, 1: 1, 2: 1}
    mine = " ".join(words(60, 77))
    table = docs(spark, one, f"{mine} {other}", f"{other} {mine}")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table).collect()) == brute_repeats([one, f"{mine} {other}", f"{other} {mine}"], 50)


def test_similar_documents_of_an_empty_table(spark):
    assert jaccard_join.similar_documents(docs(spark)).collect() == []
    assert jaccard_join.one_per_group(docs(spark)).collect() == []


def test_marked_words_are_a_word_and_marks():
    """A word is merged once, whatever marks stand behind it; the ids stay the library's."""
    import public_tokenizers

    from parley.llm import packing

    own = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = ["Haus, Haus. Haus!! Übungen*** Übungen", "don't. don't's, x's' 's. a_b~ ª. º ɏ, ɐ, no-one's", "", " ", "(ab) ab) 'll. 'll ab'd.", "1. 2, a1. Жар. Жар"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.known[" Haus"] + own.known["!!"] == own.known[" Haus!!"] and " Übungen" in own.known


def test_words_numbered_by_arrow_have_the_vocabularys_ids():
    import public_tokenizers

    encoder = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for texts in ([], ["", ""], ["a  b"], ["a  b", "c d", "", "x\ny", "c d"], ["\0", "a\nb", "don't stop, it's 5.3€ ok!"], ["<|endoftext|> a", "日本 語"]):
        assert [ids.tolist() for ids in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(encoder.known)[0] == ""


def test_new_words_are_merged_many_in_a_call():
    """A call of the library for some hundreds of new words, not one for each; the ids stay its own."""
    import public_tokenizers

    class Counted:
        def __init__(self, of):
            self.of, self.calls = of, 0

        def __getattr__(self, name):
            def call(*args, **options):
                self.calls += 1
                return getattr(self.of if hasattr(self.of, name) else self.of.model, name)(*args, **options)

            return self if name == "model" else call

    encoder = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    library, letters = encoder.tokenizer, "aeinrstñóЖя日ǆß"
    texts = [" ".join("".join(letters[(k * 7 + j * j * (k + 1)) % len(letters)] for j in range(1 + k % 23)) + ("", ".", ",")[k % 3] for k in range(n)) for n in (1500, 1, 300)]
    encoder.tokenizer, encoder.merger = Counted(encoder.tokenizer), Counted(getattr(encoder, "merger", None))
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.tokenizer.calls + encoder.merger.calls <= 4 and len(encoder.known) > 800


def test_sampled_rows_are_views_and_copies_count_once():
    import pyarrow as pa

    rows = pa.table({"doc_id": pa.array([3, 1, 2]), "toxic": pa.array([1, 0, 1], pa.int32()), "at": pa.array([[5, 6], [7], [5, 6]], pa.list_(pa.int32()))})
    for table in (rows, pa.concat_tables([rows.slice(1, 2), rows.slice(0, 1)])):
        assert [(at.tolist(), y) for at, y in toxicity.distinct_rows(table)] == [([7], 0), ([5, 6], 1)]
    assert toxicity.distinct_rows(rows.slice(0, 0)) == []
