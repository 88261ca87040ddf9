"""An archive in buckets: ranges of chats, and of a large chat's messages, of which a batch only rewrites those that it touches.

A manifest lists each table's buckets, from which key on each one goes and its file, and the last batch that each feed has put
in. Commits are numbered manifests, made only if that number is still free: a reader sees the archive before a
commit or after it, two writers can't overwrite each other, and a batch that runs twice changes nothing. A
bucket that outgrows `bucket_rows` is written as several files, each of which is a bucket from then on. The driver
holds one entry for each bucket, so `bucket_rows` decides how large the manifest gets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import _declared, _put, append

LOWEST = -(1 << 63)


class Conflict(Exception):
    """Another writer has committed meanwhile."""


def keys_of(table: DataFrame) -> list[str]:
    return ["peer_id", "message_id"] if "message_id" in table.columns else ["peer_id"]


def _pairs(columns: list[pa.Array]) -> np.ndarray:
    """Keys that compare as (peer_id, message_id); nulls are lowest."""
    out = np.zeros(len(columns[0]), [("a", "<i8"), ("b", "<i8")])
    for name, column in zip("ab", columns):
        out[name] = column.fill_null(LOWEST).to_numpy(zero_copy_only=False)
    return out


def _placed(bounds: np.ndarray, keys: list[str]):
    """Each row's bucket."""

    def run(batches):
        for batch in batches:
            found = np.searchsorted(bounds, _pairs([batch.column(k).cast(pa.int64()) for k in keys]), "right") - 1
            yield batch.append_column("_bucket", pa.array(np.maximum(found, 0).astype(np.int32)))

    return run


class BucketArchive:
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = 1 << 20):
        self.spark, self.folder, self.bucket_rows = spark, folder.rstrip("/"), bucket_rows

    # -- manifests

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, number: int) -> bool:
        path, store = self._path(f"manifest/{number:012d}.json")
        return store.exists(path)

    def _newest(self) -> int:
        """The newest manifest's number; the hint may be behind."""
        path, store = self._path("manifest/HINT")
        number = int(self.spark.read.text(path.toString()).first()[0]) if store.exists(path) else 0
        while self._exists(number + 1):
            number += 1
        return number

    def manifest(self) -> dict:
        """number, tables (schema, and buckets as [lowest key, file, rows]) and feeds (their last batches)."""
        number = self._newest()
        if not number:
            return {"number": 0, "tables": {}, "feeds": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{number:012d}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        """Conflict if its number is taken."""
        path, store = self._path(f"manifest/{manifest['number']:012d}.json")
        draft, _ = self._path(f"manifest/draft-{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        context, none = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # without OVERWRITE a rename fails if there is such a file
            context.rename(store.makeQualified(draft), store.makeQualified(path), none)
        except Exception as error:
            store.delete(draft, False)
            if self._exists(manifest["number"]):
                raise Conflict(str(manifest["number"])) from error
            raise
        _put(self.spark, f"{self.folder}/manifest/HINT", str(manifest["number"]))

    def applied(self, feed: str) -> int:
        """The last batch of a feed that the archive has, -1 if none."""
        return self.manifest()["feeds"].get(feed, -1)

    # -- tables

    def read(self, table: str, chats: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table as it stands. chats: only the buckets that may hold them are read."""
        held = (manifest or self.manifest())["tables"][table]
        buckets = held["buckets"]
        if chats is not None:
            lows, wanted = [b[0][0] for b in buckets], set()
            for chat in chats:
                first = max(0, int(np.searchsorted(lows, chat, "left")) - 1)
                wanted.update(range(first, int(np.searchsorted(lows, chat, "right"))))
            buckets = [buckets[k] for k in sorted(wanted)]
        rows = self._files([b[1] for b in buckets], held["schema"])
        return rows if chats is None else rows.where(F.col("peer_id").isin(chats))

    def _files(self, files: list[str], schema: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def _bounds(self, held: dict) -> np.ndarray:
        return np.array([tuple(b[0]) for b in held["buckets"]] or [(LOWEST, LOWEST)], [("a", "<i8"), ("b", "<i8")])

    def _write(self, table: str, rows: DataFrame, ordered: bool, touched: int = 1) -> list[list]:
        """Files of rows (with _bucket, unless ordered by range) as buckets. touched: how many buckets rows belong to, which small tables would all leave to one task."""
        keys, place = keys_of(rows), f"data/{table}/{uuid.uuid4().hex}"
        own = [F.coalesce(F.col(k).cast("long"), F.lit(LOWEST)).alias(k) for k in keys] + ([] if len(keys) == 2 else [F.lit(LOWEST).alias("message_id")])
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if ordered else rows.repartition(min(touched, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "_bucket").sortWithinPartitions("_bucket", *keys)
        writer = rows.write.option("maxRecordsPerFile", self.bucket_rows)
        (writer if ordered else writer.partitionBy("_bucket")).parquet(f"{self.folder}/{place}")
        try:
            written = self.spark.read.parquet(f"{self.folder}/{place}")
        except AnalysisException:  # nothing was written, so there is no schema to be found
            return []
        # a row for each file
        found = written.select(F.input_file_name().alias("file"), F.struct(*own).alias("key")).groupBy("file").agg(F.min("key").alias("low"), F.count("*").alias("n")).collect()
        return sorted([[list(r.low), f"{place}{r.file.split(place, 1)[1]}", r.n] for r in found])

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Put whole tables in place of those that the archive has."""
        manifest = self.manifest()
        for name, table in tables.items():
            table = _declared(name, table)
            manifest["tables"][name] = {"schema": table.schema.json(), "buckets": self._write(name, table, True)}
        manifest["number"] += 1
        self._commit(manifest)

    def touched(self, table: str, keys: DataFrame, manifest: dict) -> list[int]:
        """The numbers of the buckets that hold, or would hold, rows with these keys: at most as many as there are buckets."""
        bounds = self._bounds(manifest["tables"][table])
        schema = T.StructType([*keys.schema.fields, T.StructField("_bucket", T.IntegerType())])
        return sorted(r[0] for r in keys.mapInArrow(_placed(bounds, keys_of(keys)), schema).select("_bucket").distinct().collect())

    def update(self, keys: dict[str, DataFrame], changed: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], feed: str, batch: int, tries: int = 10) -> int:
        """Commit a feed's batch. keys: of the rows that it changes, by table; changed: from the tables' touched buckets to what these hold after it.

        The number of files written. If another feed commits meanwhile, all of it is done again on what that has left.
        """
        for _ in range(tries):
            manifest = self.manifest()
            if manifest["feeds"].get(feed, -1) >= batch:
                return 0
            touched = {t: self.touched(t, k, manifest) for t, k in keys.items()}
            held = {t: manifest["tables"][t] for t in keys}
            before = {t: self._files([held[t]["buckets"][b][1] for b in own if held[t]["buckets"]], held[t]["schema"]) for t, own in touched.items()}
            files = 0
            for t, rows in changed(before).items():
                if not touched[t]:
                    continue
                schema = T.StructType.fromJson(json.loads(held[t]["schema"]))
                rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
                placed = rows.mapInArrow(_placed(self._bounds(held[t]), keys_of(rows)), T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())]))
                new = self._write(t, placed, False, len(touched[t]))
                files += len(new)
                manifest["tables"][t] = held[t] | {"buckets": sorted([b for k, b in enumerate(held[t]["buckets"]) if k not in touched[t]] + new)}
            manifest["feeds"][feed], manifest["number"] = batch, manifest["number"] + 1
            try:
                self._commit(manifest)
                return files
            except Conflict:
                continue
        raise Conflict(f"{tries} times")

    def compact(self, table: str) -> None:
        """Write a table's buckets anew, of even size."""
        manifest = self.manifest()
        held = manifest["tables"][table]
        manifest["tables"][table] = held | {"buckets": self._write(table, self._files([b[1] for b in held["buckets"]], held["schema"]), True)}
        manifest["number"] += 1
        self._commit(manifest)

    # -- logs

    def append(self, log: str, rows: DataFrame, feed: str, batch: int) -> None:
        """A batch's rows of a log; they count once the batch is committed."""
        append(rows, f"{self.folder}/log/{log}", batch, feed)

    def read_log(self, log: str) -> DataFrame:
        """The rows of all committed batches, with stream and batch; an empty table where no batch had any."""
        done = self.manifest()["feeds"]
        path, store = self._path(f"log/{log}")
        if not done or not store.exists(path):
            return self.spark.createDataFrame([], "stream string, batch int")
        rows = self.spark.read.option("inferSchema", False).parquet(f"{self.folder}/log/{log}")
        rows = rows.withColumn("stream", F.col("stream").cast("string"))
        return rows.where(F.greatest(F.lit(False), *(((F.col("stream") == f) & (F.col("batch") <= b)) for f, b in done.items())))

