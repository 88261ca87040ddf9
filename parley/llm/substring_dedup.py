"""Removal of passages that an earlier document already has, by repeated-phrase automata.

1. Scan. Every `window`-word window has one anchor: the smallest hash among its
   `anchor`-word phrases. Two equal windows have the same anchor, and about one
   phrase in twenty is an anchor. Anchors found in two documents or more recur.
2. Confirm. Windows with a recurring anchor are grouped by a 128-bit hash under a key drawn for each
   call, so that texts can't be built to collide. A window
   in two documents or more belongs to the first of them; a document's consecutive
   such windows form a passage. Its text is kept once. No window is in two passages.
3. Compile and stream. Documents with recurring anchors are dealt over shards of about
   `shard_bytes`. A shard gets each passage that shares an anchor with one of its documents,
   once, and compiles them into an Aho-Corasick automaton. Patterns are the passage's
   consecutive half windows: every window within a passage holds one of them whole.
   The shard's documents are streamed through the automaton. Windows around a hit are looked up
   among those of the passages, the words of document and passage are compared along each run
   of such windows, and the words that they cover go. So a hit costs the same however many
   passages share its pattern.

Documents that repeat an earlier one word for word are settled by the SHA-256 of the
whole sequence first, so that thousands of copies cost one row each.
Every exchange is keyed by an anchor, a window or a document, and pre-aggregated;
a hot passage reaches a shard once, however many documents share it.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .common import FIRST, SECOND, WORD, Words, hash_key, lists, running_min, scratch, signed, sliced, staged, table, text_rows, unused

EMPTY = hashlib.sha256(b"").hexdigest()


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word, the anchor of the window that starts there, and whether there is one."""
    least = running_min(words.grams(anchor), window - anchor + 1)
    return signed(least), words.left() >= window


def _digests(words: Words) -> list[str]:
    """The SHA-256 of each row's words, joined by one space."""
    joined, rows, *_ = words.joined()
    return [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(rows.tolist(), rows[1:].tolist())]


def _scan(window: int, anchor: int, key: int):
    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column("text"), key=key)
            least, whole = _anchors(words, window, anchor)
            rows, values = words.row_of()[whole], least[whole]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
            rows, values = rows[new], values[new]
            yield table({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "kept_sha256": pa.array(_digests(words)),
                "anchors": lists(values, np.bincount(rows, minlength=batch.num_rows), pa.int64()),
            })

    return run


def _windows(window: int, anchor: int, key: int):
    """(w1, w2, doc_id) of every window with a recurring anchor."""

    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column("text"), key=key)
            least, whole = _anchors(words, window, anchor)
            hot = batch.column("hot").flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(whole & np.isin(least, hot))
            rows = words.row_of()[at]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            w1, w2 = words.grams(window, FIRST)[at], words.grams(window, SECOND)[at]
            for k in range(0, max(1, len(at)), 50_000):
                own = slice(k, k + 50_000)
                yield table({"w1": pa.array(signed(w1[own])), "w2": pa.array(signed(w2[own])), "doc_id": pa.array(ids[rows[own]])})

    return run


def _passages(window: int, anchor: int, key: int):
    """(owner, start, text, anchors) of each run of consecutive owned windows."""

    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column("text"), key=key)
            least, whole = _anchors(words, window, anchor)
            joined, _, begins, ends = words.joined()
            grams = signed(words.grams(window, FIRST))
            out = {"owner": [], "start": [], "text": [], "anchors": []}
            for i, (doc, owned) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("owned"))):
                first, end = words.offsets[i : i + 2]
                pos = first + np.flatnonzero(whole[first:end] & np.isin(grams[first:end], owned.values.to_numpy()))
                for part in np.split(pos, np.flatnonzero(np.diff(pos) > 1) + 1):
                    if len(part):
                        out["owner"].append(doc)
                        out["start"].append(int(part[0] - first))
                        out["text"].append(joined[begins[part[0]] : ends[part[-1] + window - 1]].decode())
                        out["anchors"].append(np.unique(least[part]).tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("owner", pa.int64()), ("start", pa.int32()), ("text", pa.string()), ("anchors", pa.list_(pa.int64()))]))

    return run


class Passages:
    """A shard's passages: an automaton of their half windows, and the place of every window.

    Texts are handled as bytes, one character a byte, so that places in them are those of the automaton.
    """

    def __init__(self, owners: np.ndarray, texts: pa.ChunkedArray, window: int, key: int = 0):
        self.window, self.half, self.owners = window, window // 2, owners
        words = Words(texts, key=key)
        self.joined, _, self.begins, self.ends = words.joined()
        self.machine = ahocorasick.Automaton()
        for first, end in zip(words.offsets.tolist(), words.offsets[1:].tolist()):
            for k in range(first, end - self.half + 1, self.half):
                pattern = self.joined[self.begins[k] : self.ends[k + self.half - 1]]
                self.machine.add_word(f" {pattern.decode('latin-1')} ", 1)
        if len(self.machine):
            self.machine.make_automaton()
        at = np.flatnonzero(words.left() >= window)
        w1, w2 = words.grams(window, FIRST)[at], words.grams(window, SECOND)[at]
        order = np.lexsort((w2, w1))
        self.w1, self.w2, self.at, self.row = w1[order], w2[order], at[order], words.row_of()[at][order]

    def near_hits(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """For each word of a text whose words end at `ends`, whether a window from there on holds a pattern."""
        hits = np.fromiter((end for end, _ in self.machine.iter(f" {text.decode('latin-1')} ")), np.int64)
        last = np.searchsorted(ends, hits - 1)  # the pattern's closing space stands right after its last word
        edge = np.zeros(len(ends) + 1, np.int64)
        np.add.at(edge, np.maximum(last - self.window + 1, 0), 1)
        np.add.at(edge, last - self.half + 2, -1)
        return np.cumsum(edge)[:-1] > 0

    def repeated(self, words: Words, docs: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """For each word of some documents, whether a window of an earlier owner's passage covers it; and the documents, joined."""
        gone = np.zeros(len(words.bytes_from), bool)
        joined, rows, begins, ends = words.joined()
        near = words.left() >= self.window
        for i in range(len(docs)):
            a, b = words.offsets[i], words.offsets[i + 1]
            if b - a >= self.window and len(self.machine):
                near[a:b] &= self.near_hits(joined[rows[i] : rows[i + 1]], ends[a:b] - rows[i])
            else:
                near[a:b] = False
        at = np.flatnonzero(near)
        if len(at):
            w1, w2 = words.grams(self.window, FIRST)[at], words.grams(self.window, SECOND)[at]
            found = np.minimum(np.searchsorted(self.w1, w1), len(self.w1) - 1)
            row = self.row[found]
            good = (self.w1[found] == w1) & (self.w2[found] == w2) & (self.owners[row] < docs[words.row_of()[at]])
            at, there, row = at[good], self.at[found[good]], row[good]
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(there) != 1) | (np.diff(row) != 0)) + 1
            for run in np.split(np.arange(len(at)), cuts):
                if len(run):
                    self._compare(joined, begins, ends, int(at[run[0]]), int(there[run[0]]), len(run), gone)
        return gone, joined, rows, begins

    def _compare(self, joined: bytes, begins: np.ndarray, ends: np.ndarray, a: int, b: int, n: int, gone: np.ndarray) -> None:
        """n windows in a row: their words must be those of the passage, all at once or window by window."""
        if joined[begins[a] : ends[a + n + self.window - 2]] == self.joined[self.begins[b] : self.ends[b + n + self.window - 2]]:
            gone[a : a + n + self.window - 1] = True
        elif n > 1:
            for k in range(n):
                self._compare(joined, begins, ends, a + k, b + k, 1, gone)


def _locate(window: int, key: int):
    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        out = {"doc_id": [], "kept_sha256": [], "n_removed": [], "kept": []}
        if phrases.num_rows:
            passages, seen = Passages(phrases.column("owner").to_numpy(), phrases.column("phrase"), window, key), set()
            for batch in sliced(docs.select(["doc_id", "text"]).to_batches()):
                words, ids = Words(batch.column("text"), key=key), batch.column("doc_id").to_numpy()
                gone, joined, rows, _ = passages.repeated(words, ids)
                for i in np.unique(words.row_of()[gone]).tolist():
                    text = joined[rows[i] : rows[i + 1]]
                    own = int(ids[i]), hashlib.sha256(text).hexdigest()
                    if own not in seen:
                        seen.add(own)
                        lost = gone[words.offsets[i] : words.offsets[i + 1]]
                        for name, value in zip(out, (*own, int(lost.sum()), b" ".join(itertools.compress(text.split(b" "), (~lost).tolist())).decode())):
                            out[name].append(value)
        return pa.table(out, pa.schema([("doc_id", pa.int64()), ("kept_sha256", pa.string()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, anchor: int = 12, shard_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and with_text: kept, whole_sha256).

    A word goes if a `window`-word window that covers it also starts in a document with
    a smaller id. Null and empty texts have no words. Rows with a null id are returned
    unchanged and take no part. Rows that share an id are one document for the comparison
    and are returned one by one, each with its own words. Shorter documents than a window lose
    nothing. Other columns of docs don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder, key = scratch(spark), hash_key()
    docs = text_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scan = staged(docs.mapInArrow(_scan(window, anchor, key), "doc_id long, n_words long, kept_sha256 string, anchors array<long>"), folder, "scan")

    first = scan.where("doc_id is not null and n_words > 0").groupBy("kept_sha256").agg(F.min("doc_id").alias("first_id"), F.min_by("anchors", "doc_id").alias("anchors"))
    first = staged(first, folder, "first")
    anchors = first.select(F.col("first_id").alias("doc_id"), F.explode("anchors").alias("a"))
    recurring = anchors.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    hot = anchors.join(recurring, "a").groupBy("doc_id").agg(F.collect_set("a").alias("hot"))
    some = staged(docs.join(hot, "doc_id"), folder, "some")
    shards = max(1, -(-(some.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    some = some.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    windows = some.select("doc_id", "text", "hot").mapInArrow(_windows(window, anchor, key), "w1 long, w2 long, doc_id long")
    owned = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi")).where("doc_id < hi")
    owned = owned.groupBy("doc_id").agg(F.collect_list("w1").alias("owned"))
    passages = staged(some.select("doc_id", "text").join(owned, "doc_id").mapInArrow(_passages(window, anchor, key), "owner long, start int, text string, anchors array<long>"), folder, "passages")

    reached = some.select("shard", F.explode("hot").alias("a")).distinct()
    routes = passages.select("owner", "start", F.explode("anchors").alias("a")).join(reached, "a").select("shard", "owner", "start").distinct()
    phrases = routes.join(passages.select("owner", "start", "text"), ["owner", "start"]).select(F.col("shard").alias("part"), "owner", F.col("text").alias("phrase"))
    found = some.select("shard", "doc_id", "text").groupBy("shard").cogroup(phrases.groupBy("part")).applyInArrow(_locate(window, key), "doc_id long, kept_sha256 string, n_removed long, kept string")
    found = staged(found.select("doc_id", "kept_sha256", "n_removed", F.sha2("kept", 256).alias("new_sha256"), *(["kept"] if with_text else [])), folder, "found")

    copy = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
    out = scan.drop("anchors").join(first.select("kept_sha256", "first_id"), "kept_sha256", "left").join(found, ["doc_id", "kept_sha256"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("new_sha256", "kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"), F.col("kept_sha256").alias("whole_sha256")] if with_text else []),
    )


def _with_digest(name: str):
    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_digests(Words(batch.column("text"))), pa.string())], [*batch.schema.names, name])

    return run


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated passages taken out, columns as given.

    A text that loses words becomes its kept words joined by one space, with n_chars
    counted anew; other texts, null and empty ones too, stay byte for byte. Documents that lose
    every word go. Rows that share an id are treated one by one; those without id stay. Other
    columns, whatever their names, are carried along. An empty table stays empty.
    """
    done = remove_repeats(docs, with_text=True, **options).where("n_removed > 0").dropDuplicates(["doc_id", "whole_sha256"])
    sha, key, digest, kept, gone = unused(docs, "sha", "done_id", "done_sha", "kept", "gone")
    done = done.select(F.col("doc_id").alias(key), F.col("whole_sha256").alias(digest), F.col("kept").alias(kept), (F.col("n_removed") >= F.col("n_words")).alias(gone))
    rows = docs.mapInArrow(_with_digest(sha), T.StructType([*docs.schema.fields, T.StructField(sha, T.StringType())]))
    rows = rows.join(done, (rows["doc_id"] == done[key]) & (rows[sha] == done[digest]), "left").where(f"{gone} is null or not {gone}")
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["WORD", "op1_substring_dedup", "remove_repeats", "without_repeats"]
