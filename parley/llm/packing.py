"""Packing of documents into fixed windows by lexical retrieval.

1. Encode every document once. Document frequencies of token ids and the mean length are counted
   over all documents.
2. Shards. A document's most telling terms are, of its rarest tokens that another document has too,
   those of highest BM25 weight. Documents are put in the order of their three most telling terms, by
   a range partitioning, so that lexical neighbours lie side by side. About `shard_tokens` tokens in a row
   are a shard. A hot term fills as many shards as it needs; no group has to fit anywhere.
3. Retrieve and fill. Each shard has a BM25 inverted index with the corpus's frequencies. A seed
   document asks for its unused neighbours, which greedily fill its window: first with its
   most telling terms and, while the window isn't full, with further ones, up to all. The one
   that crosses the window's end is cut there, and its rest opens the next window as the next seed.
   A partition's windows run on from shard to shard, so only its last isn't full; that is cut into
   sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sliced, staged, text_rows
from .sentencepiece_codec import batch_ids, forget, remembered

END_ID = 1


#: White space beside single spaces and line ends, and the mark that split() uses: such texts are split by the vocabulary's own pattern.
SPACED = ("  ", " \n", "\n ", "\n\n", "\0", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))


def visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write bytes that aren't printable as the characters from 256 on, in the order of the bytes."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


VISIBLE = visible_bytes()
#: The same by byte, as code points; 0xFF, which is in no text, becomes the space that no such word has.
SHOWN = np.array([VISIBLE.get(b, b) for b in range(255)] + [0x20], "<u4")
#: Words that a worker keeps between tasks.
LASTING = 400_000


class WordTokenizer:
    """ids of a byte-level BPE tokenizer, which splits a text into words by its pattern before it merges.

    No word of the pattern goes on over a single space or line end, so texts fall apart there, and what lies between
    is encoded once while the memory of `most` parts lasts. A word with marks behind it is the word's ids and the marks'.
    Texts with the string of a special token are encoded as a whole.
    """

    #: The pattern cuts between letters and these; an apostrophe may begin a word of its own, so it isn't one.
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
    LATIN = regex.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, path: str, pattern: str, most: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # the same model without the pattern: it merges words that are known to be one, written as the vocabulary shows bytes
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.width = np.zeros(self.merger.get_vocab_size(), np.int64)
        for token, k in self.merger.get_vocab().items():
            self.width[k] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.most, self.known = regex.compile(pattern), most, {"": b""}

    @staticmethod
    def spaced(text: str) -> bool:
        """Whether the pattern must split the text, as single spaces and line ends alone don't tell where its words begin."""
        return text[-1:] in (" ", "\n") or any(s in text for s in SPACED)

    def split(self, text: str) -> list[str]:
        if self.spaced(text):
            return self.pattern.findall(text)
        return [w for w in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if w]

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts that fall apart at single spaces and line ends. Arrow splits them, numbers their words and puts the ids in their places, so that Python only sees each word once."""
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        numbered = words.values.dictionary_encode()
        own = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in own if w not in self.known])
        found = pa.array(list(map(self.known.__getitem__, own)), pa.large_binary()).take(numbered.indices)
        _, ends, ids = found.buffers()
        ids = np.frombuffer(ids or b"", np.uint32)
        cuts = np.frombuffer(ends, np.int64, len(found) + 1)[words.offsets.to_numpy()] >> 2
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _merged(self, words: list[str], chunk: int = 256) -> list[bytes]:
        """The ids of words that the pattern doesn't split, many in a call. The vocabulary has all bytes, so the tokens' widths tell where a word ends."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the library looks at each call
        raw = [w.encode() for w in words]
        shown = [SHOWN[np.frombuffer(b"\xff".join(raw[a : a + chunk]), np.uint8)].tobytes().decode("utf-32-le") for a in range(0, len(raw), chunk)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast(shown, add_special_tokens=False))])
        ends = np.append(0, np.cumsum(self.width[ids]))
        want = np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
        at = np.searchsorted(ends, want)
        if ends[-1] != want[-1] or (ends[at] != want).any():
            raise ValueError("a word whose bytes the vocabulary lacks")
        ids, cuts = ids.tobytes(), (4 * at).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> None:
        # letters, with a space before or not, are one word of the pattern
        known, plain, rest, marked = self.known, {}, {}, []
        for part in new:
            word = part.rstrip(self.MARKS)
            if not word.removeprefix(" ").isalpha() or word != part and not word.isascii() and not self.LATIN.fullmatch(word):
                rest[part] = None
                continue
            plain[word] = None
            if word != part:
                mark = part[len(word) :]
                marked.append((part, word, mark))
                rest[mark] = None
        plain, rest = ([w for w in words if w not in known] for words in (plain, rest))
        known.update(zip(plain, self._merged(plain)))
        known.update(zip(rest, batch_ids(self.tokenizer, rest, threads=False)))
        known.update((part, known[word] + known[mark]) for part, word, mark in marked)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.most:
            self.known = forget(self.known, LASTING)
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = column.to_pylist()
        whole = [any(s in t for s in self.special) for t in texts]
        spaced = [not w and self.spaced(t) for t, w in zip(texts, whole)]
        plain = iter(self._encode_plain(column.filter(pa.array([not w and not s for w, s in zip(whole, spaced)], pa.bool_()))))
        found = iter(remembered(self.known, [self.split(t) for t, s in zip(texts, spaced) if s], self._learn))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else np.frombuffer(b"".join(next(found)), np.uint32) if s else next(plain)
            for t, w, s in zip(texts, whole, spaced)
        ]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str, pattern: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path, pattern)
    return _LOADED[path]


class Corpus:
    """BM25 weights from the frequencies and the mean length of the whole corpus."""

    def __init__(self, df: np.ndarray, n: int, mean: float, k1: float = 1.2, b: float = 0.75):
        self.df, self.k1, self.b, self.mean = df, k1, b, max(1.0, mean)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        # shared terms from the rarest on, and each term's place among them
        self.rarest = np.lexsort((np.arange(len(df)), df))[int((df < 2).sum()) :]
        self.place = np.full(len(df), len(self.rarest), np.int32)
        self.place[self.rarest] = np.arange(len(self.rarest))
        self.idf_at = self.idf[self.rarest].tolist()

    def weights(self, terms: np.ndarray, counts: np.ndarray, size) -> np.ndarray:
        return self.idf[terms] * counts * (self.k1 + 1) / (counts + self.k1 * (1 - self.b + self.b * size / self.mean))

    def telling(self, ids: np.ndarray, most: int, rarest: int = 64) -> list[int]:
        """Of the document's `rarest` rarest tokens that other documents have too, the terms of highest weight."""
        place = self.place[ids]
        counts = Counter((np.partition(place, rarest)[:rarest] if len(place) > rarest else place).tolist())
        counts.pop(len(self.rarest), None)
        length = self.k1 * (1 - self.b + self.b * len(ids) / self.mean)
        best = sorted((-self.idf_at[p] * n / (n + length), p) for p, n in counts.items())
        return [int(self.rarest[p]) for _, p in best[:most]]


def distinct(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each id once, without sorting; place has room for a number for every id."""
    at = np.arange(len(ids), dtype=place.dtype)
    place[ids] = at
    return ids[place[ids] == at]


def corpus_of(documents: list[np.ndarray]) -> Corpus:
    """The statistics of a corpus in memory."""
    df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(d) for d in documents)]).astype(np.int64))
    return Corpus(df, len(documents), float(np.mean([len(d) for d in documents] or [0])))


class Index:
    """A shard's BM25 inverted index: for each term the documents that have it, with their weights."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus):
        self.n = len(documents)
        sizes = np.array([len(d) for d in documents], np.int64)
        terms, rows = np.concatenate(documents), np.repeat(np.arange(self.n, dtype=np.uint32 if self.n > 1 << 16 else np.uint16), sizes)
        order = np.argsort(terms, kind="stable")
        terms, rows = terms[order], rows[order]
        new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1]))) if len(terms) else np.zeros(0, np.int64)
        counts, terms, self.rows = np.diff(np.append(new, len(terms))), terms[new], rows[new]
        self.first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else new
        self.df = np.diff(np.append(self.first, len(terms)))
        self.weights = corpus.weights(terms, counts, sizes[self.rows])
        # where each document's terms stand, and which terms those are
        self.position = np.repeat(np.arange(len(self.first)), self.df)
        self.own = np.argsort(self.rows, kind="stable")
        self.ends = np.cumsum(np.bincount(self.rows, minlength=self.n))

    def steps(self, row: int, used: np.ndarray, query_terms: int) -> Iterator[np.ndarray]:
        """Unused documents that share a term with the row's, best first, as further terms find them.

        The row's `query_terms` most telling terms ask first, then four times as many, up to all.
        `used` is looked at anew in each step. Equals go in the order of rows.
        """
        own = self.own[self.ends[row - 1] if row else 0 : self.ends[row]]
        own = own[np.argsort(-self.weights[own], kind="stable")]
        own = self.position[own]
        own = own[self.df[own] > 1]
        while len(own):
            asked = own[:query_terms]
            sizes = self.df[asked]
            at = np.arange(sizes.sum()) + np.repeat(self.first[asked] - np.cumsum(sizes) + sizes, sizes)
            score = np.bincount(self.rows[at], self.weights[at], self.n)
            score[used] = 0
            found = np.flatnonzero(score > 0)
            yield found[np.argsort(-score[found], kind="stable")]
            if query_terms >= len(own):
                return
            query_terms *= 4


def chain(documents: list[np.ndarray], corpus: Corpus, window: int, query_terms: int, filled: int = 0) -> list[int]:
    """The order in which a shard's documents fill windows one after another; the first window has `filled` tokens."""
    index, used, order = Index(documents, corpus), np.zeros(len(documents), bool), []
    sizes, seed, fresh = [len(d) for d in documents], None, 0
    while len(order) < len(documents):
        if seed is None:
            while used[fresh]:
                fresh += 1
            seed = fresh
            used[seed] = True
            order.append(seed)
            filled = (filled + sizes[seed]) % window
        near, seed = itertools.chain.from_iterable(index.steps(seed, used, query_terms)), None
        for row in near:
            used[row] = True
            order.append(int(row))
            filled += sizes[row]
            if filled >= window:
                filled %= window
                seed = int(row)
                break
    return order


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Cuts a stream of documents into sequences of `window` ids and, at its end, of powers of two."""

    def __init__(self, window: int, first_id: int):
        self.window, self.sequence, self.filled, self.parts = window, first_id, 0, []
        self.out: dict[str, list[int]] = {c.split()[0]: [] for c in FIELDS.split(", ")}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            size = min(len(ids) - start, self.window - self.filled)
            self.parts.append((doc_id, ids, start, size))
            self.filled += size
            start += size
            if self.filled == self.window:
                self._emit(self.window)

    def _emit(self, room: int) -> None:
        """Let the first `room` ids of what is held go out as a sequence."""
        offset, rest = 0, []
        for doc_id, ids, start, size in self.parts:
            now = min(size, room - offset)
            if now:
                crc = zlib.crc32(ids[start : start + now].astype("<u4").tobytes())
                for name, value in zip(self.out, (doc_id, start, now, crc, len(ids), self.sequence, offset)):
                    self.out[name].append(value)
                offset += now
            if now < size:
                rest.append((doc_id, ids, start + now, size - now))
        self.parts, self.filled, self.sequence = rest, self.filled - room, self.sequence + 1

    def end(self) -> None:
        while self.filled:
            self._emit(1 << (self.filled.bit_length() - 1))

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, {c: [] for c in self.out}
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})


def _encode(path: str, pattern: str, kind: str):
    """Each document's token ids and the end token."""

    def run(batches):
        encoder = tokenizer(path, pattern)
        for batch in sliced(batches, most=2 << 20):
            found = encoder.encode(pc.fill_null(batch.column("text"), ""))
            ids = [np.append(e, np.uint32(END_ID)).astype(kind).tobytes() for e in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})
        encoder.known = forget(encoder.known, LASTING)

    return run


def _vocabulary(path: str, pattern: str):
    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([tokenizer(path, pattern).tokenizer.get_vocab_size()], pa.int64())})

    return run


def _documents(batch: pa.RecordBatch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(raw, kind) for raw in batch.column("ids").to_pylist()]


def _frequencies(kind: str, vocabulary: int):
    """How many documents of the partition have each term; at -1 how many there are, at -2 how many tokens they have."""

    def run(batches):
        df, n, tokens, place = np.zeros(0, np.int64), 0, 0, np.zeros(vocabulary, np.int32)
        for batch in sliced(batches, "ids"):
            documents = _documents(batch, kind)
            n, tokens = n + len(documents), tokens + sum(map(len, documents))
            found = np.bincount(np.concatenate([distinct(d, place) for d in documents]), minlength=len(df))
            found[: len(df)] += df
            df = found
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(terms, [-1, -2]), pa.int64()), "n": pa.array(np.append(df[terms], [n, tokens]), pa.int64())})

    return run


ROUTES = 3


def _route(shared, kind: str):
    """Documents with their most telling terms, -1 where there are no more."""

    def run(batches):
        corpus = shared.value
        for batch in sliced(batches, "ids"):
            routes = np.full((batch.num_rows, ROUTES), -1)
            for row, ids in enumerate(_documents(batch, kind)):
                own = corpus.telling(ids, ROUTES)
                routes[row, : len(own)] = own
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), **{f"r{k}": pa.array(routes[:, k], pa.int32()) for k in range(ROUTES)}})

    return run


def _shards(batches, kind: str, shard_tokens: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and tokens of the documents of one shard after another."""
    docs, documents, size = [], [], 0
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _documents(batch, kind)):
            docs.append(doc_id)
            documents.append(ids)
            size += len(ids)
            if size >= shard_tokens:
                yield docs, documents
                docs, documents, size = [], [], 0
    if docs:
        yield docs, documents


def _pack(shared, kind: str, window: int, shard_tokens: int, query_terms: int):
    def run(batches):
        windows = Windows(window, TaskContext.get().partitionId() << 32)
        for docs, documents in _shards(batches, kind, shard_tokens):
            for row in chain(documents, shared.value, window, query_terms, windows.filled):
                windows.add(docs[row], documents[row])
            yield windows.rows()
        windows.end()
        yield windows.rows()

    return run


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, shard_tokens: int = 1 << 20, query_terms: int = 24) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every document, with the end token after each, lies in exactly one piece. A null
    text counts as empty and is the end token alone. Rows that share an id, or have none, are
    documents of their own. Sequences are `window` tokens or a power of two long, and only the last few
    of each partition are less than `window`. Other columns don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    # asked of a task, so that the driver doesn't keep a tokenizer
    vocabulary = max(spark.range(1, numPartitions=1).mapInArrow(_vocabulary(path, pattern), "n long").first()[0], END_ID + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    docs = text_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    encoded = staged(docs.mapInArrow(_encode(path, pattern, kind), "doc_id long, ids binary"), folder, "encoded")
    # at most a row for each entry of the vocabulary
    counted = encoded.select("ids").mapInArrow(_frequencies(kind, vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    n, tokens, counted = int(counted.get(-1, 0)), int(counted.get(-2, 0)), counted[counted.index >= 0]
    if not n:
        return spark.createDataFrame([], FIELDS)
    df = np.zeros(int(counted.index.max()) + 1, np.int64)
    df[counted.index] = counted
    corpus = spark.sparkContext.broadcast(Corpus(df, n, tokens / n))
    routes = [f"r{k}" for k in range(ROUTES)]
    routed = encoded.mapInArrow(_route(corpus, kind), "doc_id long, ids binary, " + ", ".join(f"{r} int" for r in routes))
    # the hash splits documents with the same terms, and makes the order the same in each run
    order = [*routes, F.xxhash64("doc_id", "ids")]
    placed = routed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    return placed.mapInArrow(_pack(corpus, kind, window, shard_tokens, query_terms), FIELDS)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """pack() with the public byte-level vocabulary of this machine."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, **options)


def op4_lexical_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
