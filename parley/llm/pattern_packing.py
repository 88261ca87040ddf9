"""Best-fit packing of documents into windows by length patterns, fitted by non-negative least squares.

1. Encode every document once; only its pieces' lengths and checksums are kept. A piece is numbered among
   those of its length in its partition.
2. The histogram of lengths, at most `window` numbers, is all that planning needs. Lengths are put into `bins`
   bins; patterns are the multisets of at most `few` bins that fill a window. How often each is
   to be repeated is the non-negative least squares fit of the histogram, rounded down.
3. Residuals, pieces that no pattern took, are packed longest first, each length where it leaves the least
   room: in windows of patterns, which have some room left as bins are rounded up, or in new ones. That
   works on counts, so its cost depends on the window and not on the number of documents.
4. Each piece finds its place by its length and its number in that length. The plan is a table of slots,
   whose number is bounded by the window as well.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, sliced, staged, text_rows
from .packing import END_ID, VISIBLE
from .sentencepiece_codec import forget, remembered


def patterns(bins: int, few: int) -> np.ndarray:
    """A column for each multiset of at most `few` bins whose sizes add up to `bins`: how often it has each bin (row 0 is size 1)."""
    found: list[list[int]] = []

    def extend(chosen: list[int], room: int, largest: int) -> None:
        if not room:
            found.append(chosen)
            return
        left = few - len(chosen)
        # the rest must fit into `left` further sizes of at most `largest`
        for size in range(min(room, largest), -(-room // left) - 1 if left else room, -1):
            extend([*chosen, size], room - size, size)

    extend([], bins, bins)
    columns = np.zeros((bins, len(found)))
    for k, chosen in enumerate(found):
        for size in chosen:
            columns[size - 1, k] += 1
    return columns


def least_squares(a: np.ndarray, b: np.ndarray, most: int = 1000) -> np.ndarray:
    """x >= 0 with a least |a x - b|, by an active set: variables enter by the steepest gradient and leave when they would turn negative."""
    x, active = np.zeros(a.shape[1]), []
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        new = int(np.argmax(gradient))
        if gradient[new] <= small:
            break
        active.append(new)
        while active:
            fit = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[active] = fit
                break
            now = x[active]
            falling = np.flatnonzero(fit <= 0)
            step = np.min(now[falling] / np.maximum(now[falling] - fit[falling], 1e-300))
            now = now + step * (fit - now)
            now[falling[np.argmin(now[falling])]] = 0
            x[active] = now
            active = [k for k, value in zip(active, now) if value > 0]
            x[[k for k in range(len(x)) if k not in active]] = 0
    return x


@dataclass
class Run:
    """`count` sequences alike: slots (length, number of the first sequence's piece in that length); the next sequence has the next numbers."""

    count: int
    room: int
    slots: list[tuple[int, int]]

    def split(self, count: int) -> Run:
        """The last sequences go; the first `count` stay."""
        rest = Run(self.count - count, self.room, [(size, first + count) for size, first in self.slots])
        self.count = count
        return rest


class Plan:
    """Where the pieces of a histogram go. histogram[n] is the number of pieces of length n, up to the window."""

    def __init__(self, histogram: np.ndarray, bins: int = 128, few: int = 3):
        self.window = len(histogram) - 1
        self.left, self.given = histogram.astype(np.int64).copy(), np.zeros(self.window + 1, np.int64)
        self.runs: list[Run] = []
        self._full(self.window, int(self.left[self.window]))
        self._patterns(min(bins, self.window), few)
        self._residuals()
        self._slots()

    def _take(self, size: int, count: int) -> int:
        """The number of the first of `count` pieces of that length."""
        first = int(self.given[size])
        self.given[size] += count
        self.left[size] -= count
        return first

    def _full(self, size: int, count: int) -> None:
        if count:
            self.runs.append(Run(count, 0, [(size, self._take(size, count))]))

    def _patterns(self, bins: int, few: int) -> None:
        edges = self.window * np.arange(bins + 1) // bins
        of = np.searchsorted(edges, np.arange(self.window + 1))  # the bin whose upper edge is the least one that holds a length
        counts = np.bincount(of, self.left, bins + 1)[1:]
        columns = patterns(bins, few)
        # a long piece that is left over costs more than a short one, which fits into many gaps
        weights = np.arange(1, bins + 1) / bins
        repeats = np.floor(least_squares(columns * weights[:, None], counts * weights) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            self._repeat([int(b) for b in np.flatnonzero(columns[:, k])[::-1] for _ in range(int(columns[b, k]))], edges, int(repeats[k]))

    def _repeat(self, chosen: list[int], edges: np.ndarray, count: int) -> None:
        """Sequences with a piece of each chosen bin, in runs in which every slot has one length.

        A bin gives its longest first; the last piece is the longest that still fits, as bins are rounded up. Ends early
        when a bin has no more.
        """
        while count:
            taken: dict[int, int] = {}
            room = self.window
            for k, b in enumerate(chosen):
                longest = room if k == len(chosen) - 1 else int(edges[b + 1])
                size = next((s for s in range(longest, int(edges[b]), -1) if self.left[s] > taken.get(s, 0)), 0)
                if not size:
                    return
                taken[size] = taken.get(size, 0) + 1
                room -= size
            now = min(count, *(int(self.left[s]) // n for s, n in taken.items()))
            self.runs.append(Run(now, room, [(s, self._take(s, now)) for s, n in taken.items() for _ in range(n)]))
            count -= now

    def _residuals(self) -> None:
        rooms: dict[int, list[Run]] = {}
        for run in self.runs:
            if run.room:
                rooms.setdefault(run.room, []).append(run)
        order = sorted(rooms)

        def put(run: Run) -> None:
            if run.room:
                if run.room not in rooms:
                    bisect.insort(order, run.room)
                    rooms[run.room] = []
                rooms[run.room].append(run)

        for size in range(self.window, 0, -1):
            while self.left[size]:
                at = bisect.bisect_left(order, size)
                if at == len(order):
                    each = min(self.window // size, int(self.left[size]))
                    count = int(self.left[size]) // each
                    run = Run(count, self.window - each * size, [(size, self._take(size, count)) for _ in range(each)])
                    self.runs.append(run)
                    put(run)
                    continue
                room = order[at]
                run = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
                # as many pieces of this length as a sequence's room takes
                each = min(room // size, int(self.left[size]))
                count = min(run.count, int(self.left[size]) // each)
                if count < run.count:
                    rest = run.split(count)
                    self.runs.append(rest)
                    put(rest)
                run.slots += [(size, self._take(size, count)) for _ in range(each)]
                run.room -= each * size
                put(run)

    def _slots(self) -> None:
        """Arrays by (length, number): up to which number a slot goes, and the sequence and offset of its first piece."""
        rows, sequence = [], 0
        for run in self.runs:
            offset = 0
            for size, first in run.slots:
                rows.append((size, first, sequence, offset))
                offset += size
            sequence += run.count
        self.sequences = sequence
        rows.sort()
        self.size, self.first, self.sequence, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        self.begins = np.searchsorted(self.size, np.arange(self.window + 2))
        del self.runs, self.left, self.given

    def places(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece, told by its length and its number in that length."""
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            slots = slice(self.begins[size], self.begins[size + 1])
            first = self.first[slots]
            at = np.searchsorted(first, numbers[own], "right") - 1
            sequence[own] = self.sequence[slots][at] + numbers[own] - first[at]
            offset[own] = self.offset[slots][at]
        return sequence, offset


class WordEndTokenizer:
    """ids of a BPE tokenizer with word ends, whose pattern takes no white space into a word.

    Texts fall apart at spaces and line ends; each part is encoded once while the memory of `most` parts
    lasts. Letters of Latin-1, with or without sentence marks behind them, go straight to the
    model in lower case; all other parts go through the tokenizer as they are.
    """

    PLAIN = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known, self.marks = most, {}, {"": b""}

    def _learn(self, new: list[str]) -> None:
        merge, match, rest = self.tokenizer.model.tokenize, self.PLAIN.fullmatch, []
        for part in new:
            found = match(part)
            if not found:
                rest.append(part)
                continue
            word, mark = found.groups()
            if mark not in self.marks:
                self.marks[mark] = array("I", self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
            word = word.lower()
            word = word if word.isascii() else word.encode().decode("latin-1").translate(VISIBLE)
            self.known[part] = array("I", [t.id for t in merge(word)]).tobytes() + self.marks[mark]
        spaces = [part for part in rest if not part.strip()]
        self.known.update(dict.fromkeys(spaces, b""))
        for part in rest:
            if part.strip():
                self.known[part] = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit numbers."""
        if len(self.known) > self.most:
            self.known = forget(self.known)
        return [b"".join(ids) for ids in remembered(self.known, [t.replace("\n", " ").split(" ") for t in texts], self._learn)]


_LOADED: dict[str, WordEndTokenizer] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pieces(path: str, window: int):
    """Pieces of at most `window` ids, each numbered among those of its length in this partition."""

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = WordEndTokenizer(path)
        encoder, part, seen = _LOADED[path], TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches, most=2 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    raw = ids[at : at + 4 * window]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(raw) // 4, zlib.crc32(raw))):
                        column.append(value)
            sizes = np.array(out[3], np.int64)
            order = np.argsort(sizes, kind="stable")
            starts = np.searchsorted(sizes[order], sizes[order])
            nth = np.zeros(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - starts + seen[sizes[order]]
            seen += np.bincount(sizes, minlength=window + 1)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)] + [pa.array(np.full(len(sizes), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])
        encoder.known = forget(encoder.known)

    return run


def _place(shared):
    def run(batches):
        for batch in batches:
            sequence, offset = shared.value.places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_patterns(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, bins: int = 128, few: int = 3) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    Every token of every document, with the end token after each, lies in exactly one piece; only documents of
    more than `window` tokens are cut, into pieces of `window` and a last one that may be shorter. Sequences have
    at most `window` tokens, without gaps. A null text counts as empty and is the end token alone. Rows that
    share an id, or have none, are documents of their own. Other columns don't matter. An empty table gives no
    rows. Which of several pieces of a length goes where is decided by the partition that read it.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    docs = text_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = staged(docs.mapInArrow(_pieces(path, window), PIECES), folder, "pieces")
    # a row per partition and length
    counted = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), folder, "counted")
    # at most `window` rows
    found = counted.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return spark.createDataFrame([], FIELDS)
    histogram = np.zeros(window + 1, np.int64)
    histogram[found["length"].to_numpy()] = found["n"].to_numpy()
    plan = spark.sparkContext.broadcast(Plan(histogram, bins, few))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    numbered = pieces.join(begins, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("begin") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(_place(plan), FIELDS)


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in windows of 4096 tokens of the public vocabulary with word ends."""
    import public_tokenizers

    return pack_patterns(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
