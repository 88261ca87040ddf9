"""WARC archives with deduplicated payloads, and their capture index by external merge.

Write: each task writes gzip WARC files of at most about `file_bytes`, one member per record, under
a name of its own, so a task that runs twice leaves a file that no table names. Of records with
equal payloads the one with the largest page id is a response, the others revisit it.
Read: archives are read back record by record; payloads are digested anew. Each file's captures
are sorted by URL key and timestamp: one run a file. Runs are cut by range, not by key, so a
hot URL is spread too; every range merges its pieces of the runs with a loser tree. Ranges are
ordered, so together they are the capture history of all URLs in order.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sliced, staged

START = datetime(2020, 1, 1, tzinfo=UTC)
FILES = pa.schema([("path", pa.string())])
CAPTURE = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("run", pa.string()),
])
CAPTURE_DDL = "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, run string"


def url_key(url: str) -> str:
    """The URL with its host reversed, so that a site's pages sort together; without scheme, www and fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' * bool(query)}{query}"


def capture_time(page_id: int | None) -> str:
    """Without a capture time in the input, pages count as captured a second apart in the order of their ids."""
    return (START + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(text: str) -> str:
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str, payload: bytes, digest: str, owner: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if owner is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(owner)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow knows: a local path, file:, hdfs:, s3: and others."""
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (fs.LocalFileSystem(), folder)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, file_bytes: int):
    def run(batches):
        store, base = _file_system(folder)
        store.create_dir(base, recursive=True)
        paths, out, size = [], None, 0
        try:
            for batch in sliced(batches, "html"):
                for page_id, url, html, owner in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "owner"))):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        paths.append(posixpath.join(base, f"{uuid.uuid4().hex}.warc.gz"))
                        out, size = store.open_output_stream(paths[-1], compression=None), 0
                    payload = (html or "").encode()
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url or "", payload, base32_sha1(payload), owner)) + pack.flush()
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict({"path": paths}, schema=FILES)

    return run


def read_records(source, block: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each gzip member, a block of the file at a time."""
    left, offset = b"", 0
    while True:
        pack, parts, used = zlib.decompressobj(31), [], 0
        while not pack.eof:
            left = left or source.read(block)
            if not left:
                if parts:
                    raise ValueError("a record ends early")
                return
            parts.append(pack.decompress(left))
            used += len(left) - len(pack.unused_data)
            left = pack.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield offset, names, body[: int(names["Content-Length"])]
        offset += used


def _page_id(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def captures(path: str, folder: str) -> list[dict]:
    """The sorted run of one archive file. Payload sizes and digests are those of what is read."""
    store, _ = _file_system(folder)
    found = []
    with store.open_input_stream(path, compression=None) as source:
        for offset, names, block in read_records(source):
            http, _, payload = block.partition(b"\r\n\r\n")
            size, digest = int(http.rsplit(b"Content-Length: ", 1)[1]), names["WARC-Payload-Digest"].removeprefix("sha1:")
            if names["WARC-Type"] == "response":
                size, said = len(payload), digest
                digest = base32_sha1(payload)
                if said != digest:
                    raise ValueError(f"{path}: the payload at {offset} has changed")
            uri = names["WARC-Target-URI"]
            found.append({
                "url_key": url_key(uri), "timestamp": names["WARC-Date"], "page_id": _page_id(names["WARC-Record-ID"]), "url": uri, "payload_bytes": size, "payload_digest": digest,
                "record_type": names["WARC-Type"], "refers_to": _page_id(names["WARC-Refers-To"]) if "WARC-Refers-To" in names else None, "file": path, "offset": offset, "run": path,
            })
    return sorted(found, key=_order)


def _order(row: dict) -> tuple:
    return row["url_key"], row["timestamp"], row["page_id"] is None, row["page_id"] or 0, row["file"], row["offset"]


def _indexer(folder: str):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = captures(path, folder)
                for a in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 5000], schema=CAPTURE)

    return run


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return self.heads[a][0] <= self.heads[b][0]

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner][1]
            w = self.winner
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._before(self.loser[node], w):
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.winner = w


def _merge(batches):
    """A range's pieces arrive run by run; a new run also begins wherever the order breaks."""
    runs: list[list[dict]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if not runs or runs[-1][-1]["run"] != row["run"] or _order(row) < _order(runs[-1][-1]):
                runs.append([])
            runs[-1].append(row)
    out = []
    for row in LoserTree(runs, _order):
        out.append(row)
        if len(out) == 5000:
            yield pa.RecordBatch.from_pylist(out, schema=CAPTURE)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=CAPTURE)


def archive(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below folder; the table of their paths."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    shared = digests.groupBy("sha1").agg(F.max("page_id").alias("owner"), F.min("page_id").alias("least")).where("least < owner").drop("least")
    revisits = staged(digests.join(shared, "sha1").where("page_id < owner").select("page_id", "sha1", "owner").distinct(), folder, "revisits")
    rows = pages.withColumn("sha1", F.sha1(payload)).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "owner")
    return staged(rows.mapInArrow(_writer(f"{folder}/warc", file_bytes), "path string"), folder, "files")


def capture_index(files: DataFrame, folder: str, ranges: int = 0) -> DataFrame:
    """Every capture of the archives, in order of URL key, timestamp and page id over all partitions."""
    spark = files.sparkSession
    n = files.count()
    runs = files.repartition(max(1, n)).mapInArrow(_indexer(folder), CAPTURE_DDL)
    runs = staged(runs, folder, "runs")
    ranges = ranges or max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id", "file", "offset").mapInArrow(_merge, CAPTURE_DDL)


def archive_and_index(pages: DataFrame, least_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """The capture index of the archives written from pages, read back from them.

    Null html is an empty payload, a null url an empty one. Equal payloads (at least `least_bytes`
    long) are one response, that of the largest page_id, and revisits; rows that repeat that page_id
    are responses each. A row without page_id is always a response. Page ids are whole numbers.
    """
    folder = scratch(pages.sparkSession)
    return capture_index(archive(pages, folder, least_bytes, file_bytes), folder)


def op10_warc_index(spark, sf_dir: str) -> DataFrame:
    found = archive_and_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")
