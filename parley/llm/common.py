"""Scratch tables, Arrow batch slicing and vectorised word hashing.

Hashes are computed over whole Arrow batches with numpy, so no Python loop runs
per word. Word separators are the space and the bytes 0x09-0x0D; every other
byte, whatever script it belongs to, is part of a word.

A word is hashed eight bytes at a time, each step through a finaliser that is no linear map,
and a run of words by pairs of its halves: there are no sums of powers that texts of
a regular build could make equal. Operators whose results rest on equal hashes draw a new
`hash_key` for each call, so that no text can be written whose words collide. Whole texts are
told apart by SHA-256 or XXH3-128.
"""

from __future__ import annotations

import ctypes
import gc
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Where that setting is missing, a local folder is made if Spark runs on this machine alone (tests,
    a laptop); on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/parley-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df below folder and read it back: lineage ends at files that survive an executor."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    # the finished job's shuffle files go as soon as the driver forgets its plan
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Let the system have the memory that Python has freed. The driver goes on after a model was fitted on it, and the allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the wanted columns, so that extra ones can't clash with ours."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of docs has it, in any case."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def fold(column, modulus: int):
    """crc32 of the id as text, modulo modulus; the hold-out rule of the labelled operators."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `most` bytes of the column (a longer row comes alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


BYTES, FIRST, SECOND = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
#: the lowest 0 to 8 bytes
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: spans of more bytes are hashed one by one
LONG = 64


def hash_key() -> int:
    """A key that nobody knows beforehand, for the word hashes of one call of an operator."""
    return secrets.randbits(63)


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes raw[start:end] of every span, eight bytes a step."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    sizes = ends - starts
    h = mix((eight[starts] & LOW[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)))
    at = np.flatnonzero(sizes > 8)
    for k in range(8, LONG, 8):
        at = at[sizes[at] > k]
        if not len(at):
            break
        h[at] = mix(h[at] * np.uint64(BYTES) ^ (eight[starts[at] + k] & LOW[np.minimum(sizes[at] - k, 8)]))
    for k in np.flatnonzero(sizes > LONG):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].data, seed)
    return h


def runs_hash(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of the k values from each on, joined from runs of powers of two; meaningless for the last k - 1."""

    def join(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        out = left * np.uint64(0xFF51AFD7ED558CCD)
        out[:-shift] ^= right[shift:]
        return mix(out)

    part, size, out, covered = mix(values + np.uint64(seed)), 1, None, 0
    while True:
        if k & size:
            out = part if out is None else join(out, part, covered)
            covered += size
        if 2 * size > k:
            return out
        part, size = join(part, part, size), 2 * size


class Words:
    """The words of a string column: hashes of all words under a key, and where each row's words begin.

    separator: for each byte, whether it is no part of a word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, key: int = 0, separator: np.ndarray = SEPARATOR):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        if lower:
            raw = LOWER[raw]
        self.key, self.raw, self.inside = key, raw, ~separator[raw]
        first, last = self.inside.copy(), self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
        first[cuts] = self.inside[cuts]
        last[cuts - 1] = self.inside[cuts - 1]
        self.bytes_from, self.bytes_to = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: row i has the words offsets[i] to offsets[i + 1]
        self.offsets = np.searchsorted(self.bytes_from, offsets)
        self.counts = np.diff(self.offsets)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans_hash(self.raw, self.bytes_from, self.bytes_to, BYTES ^ self.key)
        return self._hash

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words of its row begin at or after it."""
        return np.repeat(self.offsets[1:], self.counts) - np.arange(len(self.bytes_from))

    def grams(self, k: int, seed: int = FIRST) -> np.ndarray:
        """The hash of the k words from each word on; meaningless where left() < k."""
        return runs_hash(self.hash, k, seed) if len(self.hash) else np.zeros(0, np.uint64)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """All rows' words, a row's joined by one space: the bytes, where rows begin and the last ends, where words begin and end."""
        kept = self.inside.copy()
        more = np.ones(len(self.bytes_to), bool)
        more[self.offsets[1:][self.counts > 0] - 1] = False
        kept[self.bytes_to[more]] = True
        sizes = self.bytes_to - self.bytes_from
        begins = np.append(0, np.cumsum(sizes + more))
        return np.where(self.inside, self.raw, np.uint8(0x20))[kept].tobytes(), begins[self.offsets], begins[:-1], begins[:-1] + sizes


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: out[i] = min(values[i : i + width]), short at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
