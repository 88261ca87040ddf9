"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read field by field; its normaliser, metaspace marker, pieces with
their scores (unigram) or the merges that the scores imply (BPE) and byte fallback are rebuilt.
No piece goes on over a marker (checked on load), so a normalised text falls apart at its runs
of markers, and each distinct word is encoded and decoded once, in multithreaded batches.

Parity with the original library is verified for all of every text: both normalise the whole text
alike, and for each of its words both give the same ids and the same text for them.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table, text_rows

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: ints, bytes or 4- and 8-byte raw values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield number, data[at : at + size]
            at += size


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, type)], model_type, byte_fallback, unk, and the normaliser's settings."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk": 0, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"model_type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "unk": spec.get(40, 0)}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges a BPE model's scores imply: for every piece its splits into two pieces, best scores first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in pieces:
        if kind in (NORMAL, USER):
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[piece], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: dict):
    """(tokenizer of normalised words, normaliser) of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, *_ in pieces):
        raise ValueError("a piece goes on over a marker: words can't be encoded one by one")
    if model["model_type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], model["byte_fallback"])
    elif model["model_type"] == BPE:
        core = models.BPE(vocab={p: i for i, (p, *_) in enumerate(pieces)}, merges=merges_of(pieces), unk_token=pieces[model["unk"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(core)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    return tokenizer, normalizers.Sequence(steps)


def batch_ids(tokenizer, words: list[str], chunk: int = 512, threads: bool = True) -> list[bytes]:
    """The ids of each word, as 32-bit numbers; words are encoded in batches of `chunk`, with threads if wanted."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"  # the library looks at each call
    out = []
    for found in tokenizer.encode_batch([words[a : a + chunk] for a in range(0, len(words), chunk)], is_pretokenized=True, add_special_tokens=False):
        raw, word = np.array(found.ids, np.uint32).tobytes(), np.array(found.word_ids, np.int64)
        edges = [0, *(4 * np.flatnonzero(np.diff(word)) + 4).tolist(), len(raw)] if len(raw) else [0]
        out += [raw[a:b] for a, b in zip(edges, edges[1:])]
    if len(out) != len(words):
        raise ValueError("a word without ids")
    return out


def remembered(known: dict[str, bytes], split: list[list[str]], learn) -> list[list[bytes]]:
    """The ids of every word of every text; learn(new) puts those that aren't known yet into known."""
    get = known.get
    found = [list(map(get, words)) for words in split]
    missing = [[k for k, ids in enumerate(f) if ids is None] for f in found]
    learn(list({words[k] for words, at in zip(split, missing) for k in at}))
    for words, ids, at in zip(split, found, missing):
        for k in at:
            ids[k] = known[words[k]]
    return found


#: Words that stay in memory when others go. The first that were met are the frequent ones.
LASTING = 200_000


def forget(known: dict[str, bytes], lasting: int = LASTING) -> dict[str, bytes]:
    """The words that were met first: what a worker keeps between tasks, and when its memory is full."""
    return dict(itertools.islice(known.items(), lasting))


class Codec:
    """Encodes and decodes texts by their words, each coded once while the memory of `most` lasts."""

    def __init__(self, path: str, most: int = 1_000_000):
        import sentencepiece

        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        self.tokenizer, self.normalizer = rebuild(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.known = most, {}
        #: words that don't decode to themselves or that the original library codes in another way: decoded text, parity
        self.odd: dict[str, tuple[str, bool]] = {}

    def _learn(self, new: list[str]) -> None:
        ids = batch_ids(self.tokenizer, new)
        own = [np.frombuffer(i, np.uint32).tolist() for i in ids]
        decoded = self.tokenizer.decode_batch(own, skip_special_tokens=False)
        self.known.update(zip(new, ids))
        for text, mine, back, theirs in zip(new, own, decoded, self._originally(new)):
            if back != text.replace(MARK, " ") or (mine, back) != theirs:
                self.odd[text] = back, (mine, back) == theirs

    def _originally(self, words: list[str]) -> list[tuple[list[int], str]]:
        """The ids of normalised words and their text by the original library, which adds the dummy prefix itself."""
        prefix = self.model["dummy_prefix"]
        bare = [w.replace(MARK, " ") for w in words]
        plain = [b[1:] if prefix and b[:1] == " " else b for b in bare]
        ids = self.original.encode(plain, num_threads=1)
        back = self.original.decode(ids, num_threads=1)
        found = [(i, " " + t if prefix and b[:1] == " " else t) for i, t, b in zip(ids, back, bare)]
        if prefix and MARK in words:
            # only stands behind another word
            one, two = self.original.encode(["a", "a "])
            found[words.index(MARK)] = two[len(one) :], self.original.decode(two).removeprefix("a")
        return found

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, bool]]:
        """Per text its ids, the decoded text and whether the original library agrees."""
        normal = [self.normalizer.normalize_str(t) if t else "" for t in texts]
        split = [WORDS.findall(t) for t in normal]
        if len(self.known) > self.most:
            self.known = forget(self.known)
        found = remembered(self.known, split, self._learn)
        out = []
        for text, mine, words, ids in zip(texts, normal, split, found):
            parity, decoded = mine == self.original.normalize(text), mine.replace(MARK, " ")
            if self.odd and not self.odd.keys().isdisjoint(words):
                parity = parity and all(self.odd[w][1] for w in words if w in self.odd)
                decoded = "".join([self.odd[w][0] if w in self.odd else w.replace(MARK, " ") for w in words])
            out.append((np.frombuffer(b"".join(ids), np.uint32), decoded[1:] if self.model["dummy_prefix"] else decoded, parity))
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _code(path: str, with_ids: bool):
    def run(batches):
        own = codec(path)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = own.encode(texts)
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(ids) for ids, *_ in got], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids, *_ in got], pa.int64()),
                "round_trip": pa.array([text == back for text, (_, back, _) in zip(texts, got)], pa.bool_()), "parity": pa.array([p for *_, p in got], pa.bool_()),
            }
            if with_ids:
                columns |= {"ids": pa.array([ids.tolist() for ids, *_ in got], pa.list_(pa.int32())), "decoded": pa.array([b for _, b, _ in got], pa.string())}
            yield table(columns)
        own.known = forget(own.known)

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, parity (and ids, decoded) for every row.

    round_trip: decoding gives the text back, which holds unless the model's normaliser changes
    it or it has the marker itself. parity: the original library normalises the text alike, and gives the same
    ids for its words and the same text for them. Null texts count as empty: no tokens. Rows are coded one by one, repeated or
    without id. Other columns don't matter. An empty table gives no rows.
    """
    docs = text_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_code(path, with_ids), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>, decoded string" * with_ids)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
