"""Set-similarity join of documents on word n-grams, by token-combination prefixes.

A document's set is its distinct k-word shingles, as 64-bit hashes. With threshold t, a set
of n tokens can miss at most m = n - ceil(t n) tokens of a partner, so two linked sets share
one of their first m + 1 tokens under any fixed order.

1. Equal sets become one class, known by its smallest id. Nothing below sees copies.
2. Tokens that recur in a bounded sample of documents are the frequent class for a start and come
   last in the order. (Any order is exact; the sample only decides how few candidates are
   left.) Prefixes under it leave the candidates. Long shingles are rare: sets that share a prefix
   token. Short ones recur by chance: sets that share a combination, as in 3.
3. Candidates' tokens are counted and put in the order (count, hash), rarest first. A set with
   more than m tokens of its own drops out. Prefix tokens of the rare class (at most `frequent`
   sets) are indexed one by one. Where a prefix reaches the frequent class it is extended
   to m + d + 2 tokens (d: the most tokens that two linked sets may differ in) and each two
   frequent tokens that are neighbours in it are indexed as a combination. If all
   common tokens of a linked pair are frequent, their first d + 2 leave d + 1 gaps, which at most
   d foreign tokens can break: one combination is the same in both. So no link is lost.
4. Verify. Within an index entry all sets are first compared with one centre, that with
   the fewest tokens of its own; what links is joined into components. Then only pairs of
   different components that the sizes allow are compared. A group of thousands of near
   copies thus costs about one comparison each instead of one a pair.

Hot tokens and copies are counted before they are shuffled; joins on them are plain inner joins,
which adaptive execution splits. Hashes are made under a key that is drawn for each call, so texts can't be
built to collide; the results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_key, lists, mix, scratch, signed, sliced, staged, table, text_rows, unused
from .graph import components


def _sets(column: pa.Array, k: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, row after row; their numbers; two digests of each row's set.

    A set of one shingle is told apart by the shingle's words themselves, larger ones by all their hashes.
    """
    words = Words(column, lower=True, key=key)
    joined, begins, *_ = words.joined()
    whole = words.left() >= k
    rows, grams = words.row_of()[whole], words.grams(k)[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        rows = np.concatenate([rows, short])
        grams = np.concatenate([grams, np.array([xxhash.xxh3_64_intdigest(joined[begins[i] : begins[i + 1]], key) for i in short], np.uint64)])
    grams = signed(grams)
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    tokens, sizes = grams[new], np.bincount(rows[new], minlength=len(words.counts))
    ends = np.cumsum(sizes)
    raw = [tokens[e - n : e].tobytes() if n != 1 else b" ".join(joined[begins[i] : begins[i + 1]].split(b" ", k)[:k]) for i, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist()))]
    return tokens, sizes, np.frombuffer(b"".join(xxhash.xxh3_128_digest(r, key) for r in raw), np.int64).reshape(-1, 2)


def _missing(n, num: int, den: int):
    """How many tokens a set of n can lack in a partner."""
    return n - -(-n * num // den)


def _differ(n, num: int, den: int):
    """In how many tokens, of either, a set of n and a partner can differ."""
    return n * (den - num) // num


def _pairs(tokens: np.ndarray, following: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return signed(mix(tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + following.view(np.uint64)))


def _common(docs: DataFrame, k: int, key: int, sample: int, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Tokens of `least` or more documents of a sample of about `sample`: sorted, at most `most`."""
    share = min(1.0, sample / max(1, docs.count()))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1 << 30)) / (1 << 30)
    tokens = docs.where(dice < share).mapInArrow(_whole_sets(k, key), "doc_id long, n long, tokens array<long>").select(F.explode("tokens").alias("token"))
    found = tokens.groupBy("token").count().where(f"count >= {least}").orderBy(F.desc("count"), "token").limit(most).toPandas()
    return np.sort(found["token"].to_numpy(np.int64))


def _scan(k: int, key: int):
    def run(batches):
        for batch in sliced(batches):
            _, sizes, digests = _sets(batch.column("text"), k, key)
            yield table({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "s1": pa.array(digests[:, 0]), "s2": pa.array(digests[:, 1])})

    return run


def _prefixes(k: int, key: int, num: int, den: int, combine: bool, common):
    """(s1, key): the keys of each set's prefix."""

    def run(batches):
        often = common.value
        for batch in sliced(batches):
            tokens, sizes, digests = _sets(batch.column("text"), k, key)
            begins = np.cumsum(sizes) - sizes
            late = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens if len(often) else np.zeros(len(tokens), bool)
            ordered = tokens[np.lexsort((late, np.repeat(np.arange(len(sizes)), sizes)))]
            wanted = _missing(sizes, num, den) + 1 + combine * _differ(sizes, num, den)
            take = np.minimum(np.maximum(sizes - combine, 0), wanted)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(begins, take)
            entries = _pairs(ordered[at], ordered[at + 1]) if combine else ordered[at]
            s1 = np.repeat(digests[:, 0], take)
            for a in range(0, max(1, len(entries)), 50_000):
                yield table({"s1": pa.array(s1[a : a + 50_000]), "key": pa.array(entries[a : a + 50_000])})

    return run


def _whole_sets(k: int, key: int):
    def run(batches):
        for batch in sliced(batches):
            tokens, sizes, _ = _sets(batch.column("text"), k, key)
            yield table({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "tokens": lists(tokens, sizes, pa.int64())})

    return run


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, num: int, den: int, frequent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Index keys of a set, single tokens and combinations apart; how many of its n tokens no other set has, and how many are frequent.

    tokens: those that other sets have.
    """
    own, most, none = n - len(tokens), _missing(n, num, den), np.zeros(0, np.int64)
    if own > most:
        return none, none, own, 0
    order = np.lexsort((tokens, counts))
    tokens, often = tokens[order], counts[order] > frequent
    prefix = most + 1 - own
    singles, pairs = tokens[:prefix][~often[:prefix]], none
    if often[:prefix].any():
        part = tokens[often][: max(0, most + _differ(n, num, den) + 2 - own - int((~often).sum()))]
        pairs = _pairs(part[:-1], part[1:])
    return np.unique(singles), np.unique(pairs), own, int(often.sum())


def _index(num: int, den: int, frequent: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                out = [signatures(n, t.values.to_numpy(), c.values.to_numpy(), num, den, frequent) for n, t, c in zip(part.column("n").to_pylist(), part.column("tokens"), part.column("counts"))]
                for single, rows in ((True, [(o[0], o[2], n - o[2]) for o, n in zip(out, part.column("n").to_pylist())]), (False, [(o[1], o[2], o[3]) for o in out])):
                    sizes = [len(keys) for keys, *_ in rows]
                    again = lambda v: pa.array(np.repeat(np.array(v, np.int64), sizes))  # noqa: E731, B023
                    yield table({
                        "key": pa.array(np.concatenate([keys for keys, *_ in rows])), "single": pa.array([single] * sum(sizes), pa.bool_()), "doc_id": again(part.column("doc_id").to_pylist()), "n": again(part.column("n").to_pylist()),
                        "own": again([own for _, own, _ in rows]), "most": again([most for *_, most in rows]),
                    })

    return run


def _possible(a: str, b: str, num: int, den: int):
    """Whether sizes and the tokens that can be common let the two sets link.

    Under a single token those are all but a set's own. Sets that only meet under combinations share
    no rarer token, so there only the frequent ones count.
    """
    return F.expr(f"{num + den} * least({a}.most, {b}.most) >= {num} * ({a}.n + {b}.n)")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * (F.col("na") + F.col("nb") - both)).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, frequent: int = 16, combine: bool = True, sample: int = 3000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when den * intersection >= num * union of their sets of k-word shingles;
    A-Z count as a-z. Fewer than k words make one shingle; null and empty texts have an empty
    set and link with nothing. component_id is the smallest id reachable by links. Rows that share
    an id are one node with each of their sets. A row with a null id links with nothing.
    """
    # d + 2 common tokens are only sure from here on; below, tokens are indexed one by one
    combinable = num >= 3 * (den - num)
    combine = combinable and combine
    frequent = frequent if combinable else 1 << 60
    spark = docs.sparkSession
    folder, key = scratch(spark), hash_key()
    docs = text_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    common = spark.sparkContext.broadcast(_common(docs, k, key, sample))
    scan = staged(docs.mapInArrow(_scan(k, key), "doc_id long, n long, s1 long, s2 long"), folder, "scan")
    classes = staged(scan.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), folder, "classes")

    # made twice rather than kept: prefixes are a large part of the input's size
    prefix = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(k, key, num, den, combine, common), "s1 long, key long")
    shared = prefix.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("key")
    shared = staged(shared, folder, "shared")
    candidates = prefix.join(shared, "key").select("s1").distinct().join(classes, "s1").select(F.col("rep").alias("doc_id")).distinct()
    candidates = staged(candidates, folder, "candidates")
    sets = staged(docs.join(candidates, "doc_id").mapInArrow(_whole_sets(k, key), "doc_id long, n long, tokens array<long>"), folder, "sets")

    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    counts = staged(tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1"), folder, "counts")
    listed = tokens.join(counts, "token").groupBy("doc_id", "n").agg(F.collect_list(F.struct("token", "count")).alias("l"))
    listed = listed.select("doc_id", "n", F.col("l.token").alias("tokens"), F.col("l.count").alias("counts"))
    index = staged(listed.mapInArrow(_index(num, den, frequent), "key long, single boolean, doc_id long, n long, own long, most long"), folder, "index")

    centres = index.groupBy("key", "single").agg(F.min(F.struct("own", "doc_id", "n", "most")).alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "single", "c.*")
    star = index.alias("x").join(centres.alias("y"), ["key", "single"]).where((F.col("x.doc_id") != F.col("y.doc_id")) & _possible("x", "y", num, den))
    star = staged(star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), folder, "star")
    links = staged(_verified(star, sets, num, den), folder, "links")

    part = components(links, folder, "part")
    index = index.join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = index.groupBy("key", "single").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "single")
    index = staged(index.join(mixed, ["key", "single"]), folder, "mixed")
    # a pair is made under its first common key of either kind alone, not once for each of them
    keys = index.groupBy("doc_id", "single").agg(F.collect_set("key").alias("keys"))
    index = staged(index.join(keys, ["doc_id", "single"]), folder, "keyed")
    first_common = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    pairs = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & _possible("x", "y", num, den)
    rest = index.alias("x").join(index.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.single") == F.col("y.single")) & pairs & first_common)
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    links = links.union(staged(_verified(rest, sets, num, den), folder, "more"))

    # rows that share an id tie their classes together
    same = scan.where("n > 0").join(classes, ["s1", "s2"])
    found = components(links.union(same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), folder, "all")
    return scan.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest id of each group of similar ones, columns as given.

    Rows with a null id stay, and so do null and empty texts. Rows that share an id stay or go together.
    Other columns, whatever their names, are carried along. An empty table stays empty.
    """
    (key,) = unused(docs, "gone_id")
    gone = similar_documents(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)
