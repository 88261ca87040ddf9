"""Grouping of spelling variants by a variable-length gram index.

1. Count the words of all documents; frequent ones take part.
2. Gram dictionary. Grams grow from `shortest` characters on, and only a gram that occurs more often than a threshold is
   made longer, up to `longest`: so the dictionary is pruned by frequency. The threshold bounds
   how many grams it names, whatever the corpus, so it can be sent to every task.
3. Decompose. A word, between two marks, falls into one gram for each place: the shortest that isn't in the
   dictionary of frequent grams. What a gram is depends on its own characters alone, so one edit affects at most the grams
   that span its place. Words are compared in classes of two neighbouring lengths, and no gram is longer than
   half of the class, so that each word has more grams than one edit can affect.
4. Merge lists. A word's affected-gram bound is the most grams that one edit can touch. A near word keeps all others,
   each with the same characters before it or behind it; so of the word's bound + 1 rarest grams, one
   is among the near word's bound + 1 rarest as well. Only these lists are merged, each divided by what stands
   before the gram and by what stands behind it.
5. Verify with the edit distance itself.

A word's form is its near word of highest count; roots follow forms by pointer doubling.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged, text_rows

MARK = "\x02"
RUN = "[a-zÀ-ÿ]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, modulus: int = 97) -> DataFrame:
    """word, n: runs of letters, A-Z as a-z, of at least `shortest` characters that occur `least` times or more.

    Where the crc32 of `<id>:<run>` is divisible by modulus, the run loses the character at crc32 modulo its length.
    Null texts have no runs; a null id is written as an empty string.
    """
    rows = text_rows(docs, id_col, text_col).toDF("id", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # a run of shortest + 1 characters may get short enough, never long enough
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.where(F.length("run") >= shortest).withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % modulus == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Grams:
    """The variable-length grams of words. `frequent` holds the grams that are made longer."""

    def __init__(self, frequent: dict[str, int], shortest: int = 2, longest: int = 6):
        self.frequent, self.shortest, self.longest = frequent, shortest, longest

    def cap(self, length: int) -> int:
        """The longest gram in the class of words of `length` and `length` + 1 characters."""
        return max(self.shortest, min(self.longest, (length + 2) // 2))

    def decompose(self, word: str, length: int) -> list[str]:
        """The gram at each place of the marked word, in the class of `length`; those at the end may be short."""
        marked, cap, grams = MARK + word + MARK, self.cap(length), []
        frequent = self.frequent
        for at in range(len(marked) - self.shortest + 1):
            size = self.shortest
            gram = marked[at : at + size]
            while size < cap and at + size < len(marked) and gram in frequent:
                size += 1
                gram = marked[at : at + size]
            grams.append(gram)
        return grams

    def affected(self, grams: list[str], characters: int) -> int:
        """The most grams that one edit of the word's characters can touch.

        A replaced or deleted character touches the grams that span it; an inserted one those that span both of its neighbours. So
        no insertion touches more than a replacement of a neighbour does, as the marks stay first and last.
        """
        spans = [0] * (characters + 3)
        for at, gram in enumerate(grams):
            spans[at] += 1
            spans[at + len(gram)] -= 1
        return max(itertools.islice(itertools.accumulate(spans), 1, characters + 1))

    def rarest(self, word: str, length: int) -> list[tuple[int, int]]:
        """Where the bound + 1 rarest grams begin and end in the marked word."""
        grams = self.decompose(word, length)
        bound, count = self.affected(grams, len(word)), self.frequent.get
        # by frequency, where the dictionary tells it; below its threshold longer grams are rarer
        order = sorted((count(gram, 0), -len(gram), gram, at) for at, gram in enumerate(grams))
        return [(at, at + len(gram)) for *_, gram, at in order[: bound + 1]]

    def lists(self, word: str) -> Iterator[tuple[int, str]]:
        """The lists in which the word stands: their class, of which it has two, and their name.

        A gram left of the edit has the same characters before it in both words, one right of it the same behind it. So
        each gram's list is divided by either. What remains of the words differs by the edit, which leaves the first or
        the last half of the shorter remainder alone. So each list is divided once more, by either half.
        """
        marked, cap, spans, size = MARK + word + MARK, None, [], len(word)
        for length in (size - 1, size):
            if self.cap(length) != cap:
                cap, spans = self.cap(length), self.rarest(word, length)
            for start, end in spans:
                half = max(0, length - end + 1) // 2
                yield length, f"{length}<{start}:{marked[:end]}:{word[end - 1 : end - 1 + half]}"
                if half:
                    yield length, f"{length}<{start}:{marked[:end]}::{word[size - half :]}"
                rest = max(0, start - 1)
                half = max(0, length - size + rest) // 2
                yield length, f"{length}>{len(marked) - end}:{marked[start:]}:{word[rest - half : rest]}"
                if half:
                    yield length, f"{length}>{len(marked) - end}:{marked[start:]}::{word[:half]}"


def _signatures(shared, shortest: int, longest: int):
    """A row for each list that a word stands in, in each of its two classes; lists are told by hash, as what meets there is verified."""

    def run(batches):
        grams = Grams(shared.value, shortest, longest)
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                words = part.column("word").to_pylist()
                found = [list(grams.lists(word)) for word in words]
                counts = [len(own) for own in found]
                classes, names = zip(*itertools.chain.from_iterable(found)) if words else ((), ())
                at = pa.array(np.repeat(np.arange(len(words)), counts))
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("word").take(at), part.column("n").take(at), pa.array(keys, pa.int64()), pa.array(classes, pa.int32())], names=["word", "n", "list", "class"])

    return run


def frequent_grams(words: DataFrame, least: int, most: int, shortest: int, longest: int) -> dict[str, int]:
    """Grams of `shortest` to `longest` characters that occur more than a threshold often, with their counts.

    The threshold is `least`, or as high as it takes that no more than about `most` grams can reach it.
    """
    marked = F.concat(F.lit(MARK), "word", F.lit(MARK))
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(least, -(-places * (longest - shortest + 1) // most))
    each = [F.transform(F.sequence(F.lit(1), F.length("marked") - size + 1), lambda at, size=size: F.substring(F.col("marked"), at, F.lit(size))) for size in range(shortest, longest + 1)]
    grams = words.select(marked.alias("marked")).select(F.explode(F.concat(*each)).alias("gram"))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > least).toPandas()
    return dict(zip(found["gram"].tolist(), found["n"].tolist()))


def near_words(words: DataFrame, folder: str, least: int = 64, most: int = 500_000, shortest: int = 2, longest: int = 6) -> DataFrame:
    """a, na, b, nb: every two words of which one becomes the other by one inserted, deleted or replaced character, each way round.

    words: word, of 3 characters or more, each once, and its n.
    """
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, least, most, shortest, longest))
    # about 20,000 words a task, however small the table's files are
    dealt = words.select("word", "n").repartition(max(1, -(-words.count() // 20_000)), "word")
    index = staged(dealt.mapInArrow(_signatures(frequent, shortest, longest), "word string, n long, list long, class int"), folder, "index")
    # each two words meet in the class of the shorter one
    index = index.select("list", (F.length("word") == F.col("class")).alias("shorter"), "word", "n")
    same = F.expr("a.list = b.list and (a.shorter or b.shorter) and a.word < b.word")
    met = index.alias("a").join(index.alias("b"), same & (F.levenshtein("a.word", "b.word", 1) == 1))
    near = staged(met.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb")).distinct(), folder, "near")
    return near.union(near.select("b", "nb", "a", "na"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: the last word that following forms (word, form) leads to. No chain may come back to itself."""
    found, k = staged(forms.select("word", F.col("form").alias("root")), folder, "roots-0"), 0
    while True:
        k += 1
        ahead = found.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = found.join(ahead, found["root"] == ahead["at"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = staged(moved, folder, f"roots-{k}")
        found = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return found


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, **grams) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the corpus (see word_counts).

    Two words are near if one insertion, deletion or replacement of a character makes one the other. A word's form is its near word
    of largest n, the first in code-point order of equal ones, if that has `ratio` times the word's n or more; else null. root: where forms lead,
    the word itself without one. Null and empty texts have no words, repeated rows count as often as they stand; other columns
    don't matter. An empty table gives no rows.
    """
    folder = scratch(docs.sparkSession)
    words = staged(word_counts(docs, id_col, text_col), folder, "words")
    # UTF-8 sorts like code points
    best = near_words(words, folder, **grams).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form"))).alias("best"))
    best = best.select("a", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    rows = words.join(best, words["word"] == best["a"], "left")
    taken = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    rows = staged(rows, folder, "rows")
    ends = roots(rows.where("form is not null"), folder)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(1, length(x) // 2 + 1), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i - 1]) - 1) + instr('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT))),
    lambda h, v: xor(h >> 8, t[(xor(h, v) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS nb FROM cut a JOIN cut b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.x = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.x = w.word),
best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY nb DESC, b) AS form, max(nb) AS form_n FROM near GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON word = a),
walk AS (
  SELECT word, word AS at FROM words
  UNION ALL
  SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
