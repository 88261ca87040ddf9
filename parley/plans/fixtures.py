"""Archive tables derived from the star-schema test tables, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SPARK_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})"
DUCKDB_EPOCH = "CAST(floor(epoch({0})) AS BIGINT)"

PEERS = """
SELECT CAST(c_custkey AS BIGINT) AS peer_id,
 CASE WHEN c_custkey % 3 = 0 THEN 'user' WHEN c_custkey % 3 = 1 THEN 'group' ELSE 'channel' END AS peer_type,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS VARCHAR(20))) END AS username,
 CAST(1700000000 + c_custkey AS BIGINT) AS updated_at
FROM {customer} WHERE c_custkey % 29 <> 0
"""

MESSAGES = """
SELECT peer_id, message_id, date,
 CASE WHEN message_id % 4 = 0 THEN NULL ELSE 1 + (message_id % 97) END AS sender_id,
 CASE WHEN message_id % 13 = 0 THEN NULL ELSE concat(o_orderpriority, ' note ', CAST(message_id AS VARCHAR(20))) END AS text,
 CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'P' THEN 'edited' ELSE 'active' END AS state,
 CASE WHEN rn % 10 = 1 THEN next_id WHEN rn % 10 = 2 THEN prev_id WHEN rn % 10 = 5 THEN message_id
      WHEN rn % 10 = 6 THEN -message_id WHEN rn % 10 IN (7, 8, 9) THEN prev_id ELSE NULL END AS reply_to_msg_id,
 CASE WHEN rn % 10 = 9 THEN peer_id + 1 ELSE NULL END AS reply_to_peer_id,
 CASE WHEN rn % 10 IN (3, 4) THEN peer_id * 1000 + CAST(floor(rn / 10) AS BIGINT) ELSE NULL END AS grouped_id,
 CASE WHEN o_orderstatus = 'P' AND message_id % 3 <> 0 THEN date + 60 ELSE NULL END AS edit_date,
 message_id % 31 = 0 AS is_service
FROM (SELECT CAST(o_custkey AS BIGINT) AS peer_id, CAST(o_orderkey AS BIGINT) AS message_id,
  <o_orderdate> AS date, o_orderstatus, o_orderpriority,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_id,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_id FROM {orders}) AS numbered
"""

MEDIA = """
SELECT concat('doc_', CAST(p_partkey AS VARCHAR(20))) AS media_id,
 CASE p_partkey % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'document' WHEN 3 THEN 'voice' ELSE 'sticker' END AS kind,
 CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'application/x-mpegURL' ELSE 'video/mp4' END WHEN 2 THEN 'application/pdf' ELSE NULL END AS mime_type,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1024 END AS size_bytes,
 CASE p_partkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloading' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'skipped' WHEN 4 THEN 'permanently_failed' ELSE 'completed' END AS download_status,
 CASE p_partkey % 6 WHEN 0 THEN 'unverified' WHEN 1 THEN 'corrupted_hash' WHEN 2 THEN 'missing_file' ELSE 'verified' END AS verification_status,
 CAST(p_partkey % 4 AS INT) AS retry_count, CAST(1700000000 + p_partkey % 1000 AS BIGINT) AS created_at,
 CASE WHEN p_partkey % 7 = 2 THEN CAST(1700000000 + p_partkey % 3600 AS BIGINT) END AS next_retry_at,
 CASE WHEN p_partkey % 7 = 1 THEN CAST(1700000000 + p_partkey % 7200 AS BIGINT) END AS claimed_at,
 CASE WHEN p_partkey % 7 IN (5, 6) AND p_partkey % 11 <> 0 THEN concat('media/', CAST(p_partkey AS VARCHAR(20)), '.bin') END AS local_rel_path,
 concat('h', CAST(p_partkey % 500 AS VARCHAR(20))) AS sha256
FROM {part} WHERE p_partkey % 23 <> 0
"""

MESSAGE_MEDIA = """
SELECT CAST(o_custkey AS BIGINT) AS peer_id, CAST(l_orderkey AS BIGINT) AS message_id,
 concat('doc_', CAST(l_partkey AS VARCHAR(20))) AS media_id, 'attachment' AS role, CAST(min(l_linenumber) - 1 AS INT) AS position
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, l_partkey
"""

#: Versions of messages: a chat's events in order of time; eight keys a chat make histories.
FEED = """
SELECT CAST(user_id AS BIGINT) AS peer_id, CAST(event_id % 8 AS BIGINT) AS message_id, CAST(event_id AS BIGINT) AS event_id,
 <ts> AS date, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'delete' ELSE 'new' END AS kind,
 concat(event_type, ' ', CAST(event_id % 3 AS VARCHAR(20))) AS text, CAST(event_id % 100 AS BIGINT) AS views
FROM {events}
"""

VIEWS = {"peers": PEERS, "messages": MESSAGES, "media_objects": MEDIA, "message_media": MESSAGE_MEDIA, "feed": FEED}


def _epochs(sql: str, form: str) -> str:
    for column in ("o_orderdate", "ts"):
        sql = sql.replace(f"<{column}>", form.format(column))
    return sql


def with_views(sql: str) -> str:
    """A DuckDB query that may use the views: those it names are put before it."""
    used = [f"{n} AS ({_epochs(v, DUCKDB_EPOCH).replace('{', '').replace('}', '').strip()})" for n, v in VIEWS.items() if n in sql]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {', '.join([*used, body[15:]])}"
    return f"WITH {', '.join([*used, body[5:]])}" if body.lower().startswith("with ") else f"WITH {', '.join(used)} {body}" if used else body


#: The keys that meet in a view's join, which also group what comes of it.
KEYS = {"message_media": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: About how many bytes of a file go into one partition of such a join. Shuffles are only cut by their own, compressed size, of which
#: 60 MB were 3.6 million links and 2.8 GB of a task's memory.
PART_BYTES = 1 << 22


class Archive:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        sql = _epochs(VIEWS[name], SPARK_EPOCH)
        tables = {t: self.table(t) for t in ("customer", "orders", "part", "lineitem", "events") if "{" + t + "}" in sql}
        if keys := KEYS.get(name):
            parts = max(2, *(-(-self._bytes(t) // PART_BYTES) for t in keys))
            tables |= {t: tables[t].repartition(parts, key) for t, key in keys.items()}
        return self.spark.sql(sql, **tables)

    def _bytes(self, name: str) -> int:
        """The size of a table's files."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    @cached_property
    def peers(self) -> DataFrame:
        return self._view("peers")

    @cached_property
    def messages(self) -> DataFrame:
        return self._view("messages")

    @cached_property
    def media(self) -> DataFrame:
        return self._view("media_objects")

    @cached_property
    def links(self) -> DataFrame:
        return self._view("message_media")

    @cached_property
    def feed(self) -> DataFrame:
        return self._view("feed")
