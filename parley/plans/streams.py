"""Queries: feeds with state per chat, and archives in buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.staging import scratch, staged
from ..sources import readers
from ..sources.buckets import BucketArchive
from ..streaming import chats
from ..streaming import feed as fd
from .feeds import _updates
from .registry import query
from .storage import _applied_sql

HOUR = 3_600_000


def _archive(a, folder: str, rows: int = 1 << 12) -> BucketArchive:
    archive = BucketArchive(a.spark, f"{folder}/archive", rows)
    archive.create({t: fd.empty_table(a.spark, t) for t in ("peers", "messages", "sync_state")})
    return archive


def _run(a, archive: BucketArchive, folder: str, name: str, rows, patience: int) -> None:
    """Put rows into a feed's folder and stream them."""
    columns = [c for c in rows.columns if c in chats.COLUMNS]
    rows.select(*columns).write.mode("append").json(f"{folder}/{name}")
    chats.stream_into(readers.read_update_feed(a.spark, f"{folder}/{name}", stream=True), archive, f"{folder}/{name}-checkpoint", name, patience).awaitTermination()


@query("c1_two_feeds", _applied_sql("true"))
def _(a):
    """The account's feed and the channels' feed, by turns, into one archive; then the first again, as if its checkpoint had been lost."""
    folder = scratch(a.spark)
    archive, rows = _archive(a, folder), _updates(a)
    account, channels = rows.where("peer_id % 3 <> 2"), rows.where("peer_id % 3 = 2")
    _run(a, archive, folder, "account", account, HOUR)
    _run(a, archive, folder, "channels", channels, HOUR)
    _run(a, archive, folder, "account-again", account, HOUR)
    return archive.read("messages").select("peer_id", "message_id", "date", "text", "state")


#: One event in 23 never comes; the chats with even ids recover up to the middle of the slice at which they froze.
TURNS_SQL = """
ev AS (SELECT *, event_id % 97 = 5 AS odd, event_id % 2 = 0 AS affects, seq // 10 AS slice_id FROM feed WHERE event_id % 23 <> 7),
bl AS (SELECT peer_id, min(slice_id) AS stop FROM ev WHERE odd AND affects GROUP BY peer_id),
du AS (SELECT ev.*, stop, 10 * stop + 5 AS known FROM ev LEFT JOIN bl USING (peer_id) WHERE stop IS NULL OR slice_id < stop OR (peer_id % 2 = 0 AND seq > 10 * stop + 5)),
rd AS (SELECT * FROM du WHERE NOT odd)"""


def _turns(a) -> BucketArchive:
    """Most events, and after a restart the late ones; after another the recoveries."""
    folder = scratch(a.spark)
    archive = _archive(a, folder)
    rows = staged(_updates(a, "event_id").where("event_id % 23 <> 7"))
    late = "event_id % 5 = 0 and kind <> 'unsupported'"
    _run(a, archive, folder, "feed", rows.where(f"not ({late})"), HOUR)
    _run(a, archive, folder, "feed", rows.where(late), 0)
    stops = fd.blocked_slices(rows).where("peer_id % 2 = 0")
    recovered = stops.select("peer_id", F.lit("recovered").alias("kind"), F.col("blocked_from").alias("slice_id"), F.lit(0).cast("long").alias("seq"), (10 * F.col("blocked_from") + 5).alias("pts"))
    _run(a, archive, folder, "feed", recovered, 0)
    return archive


@query("c4_freeze_and_recovery", f"""
WITH {TURNS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY peer_id, message_id ORDER BY seq DESC) AS k FROM rd WHERE kind IN ('new', 'edit')),
 l AS (SELECT peer_id, message_id, arg_max(kind, seq) AS last FROM rd GROUP BY 1, 2)
SELECT v.peer_id, v.message_id, v.date, v.text, CASE WHEN last = 'delete' THEN 'deleted' WHEN v.kind = 'edit' THEN 'edited' ELSE 'active' END AS state,
 stop IS NOT NULL AND v.peer_id % 2 <> 0 AS uncertain
FROM v JOIN l USING (peer_id, message_id) WHERE k = 1
""")
def _(a):
    archive = _turns(a)
    return archive.read("messages").join(archive.read("sync_state").select("peer_id", "uncertain"), "peer_id").select("peer_id", "message_id", "date", "text", "state", "uncertain")


@query("c10_stream_gaps", f"""
WITH {TURNS_SQL}, p AS (SELECT *, lag(seq) OVER (PARTITION BY peer_id ORDER BY seq) AS before FROM du),
 g AS (SELECT peer_id, CASE WHEN slice_id >= stop AND (before IS NULL OR before < known) THEN known ELSE before END AS before, seq AS pts, CAST(1 AS BIGINT) AS pts_count FROM p)
SELECT * FROM g WHERE pts - 1 > before
""")
def _(a):
    return _turns(a).read_log("gaps").select("peer_id", "before", "pts", "pts_count")


@query("k1_bucket_archive", "SELECT peer_id, message_id, date, CASE WHEN peer_id % 50 = 7 THEN 'changed' ELSE text END AS text, state FROM messages UNION ALL SELECT DISTINCT peer_id, 0, 5, 'first', 'active' FROM messages WHERE peer_id % 50 = 7")
def _(a):
    """A batch of edits to some chats, put in twice; then the buckets are written anew."""
    archive = _archive(a, scratch(a.spark), 512)
    rows = staged(a.messages.select("peer_id", "message_id", "date", "text", "state"))
    archive.create({"messages": rows})
    own = rows.where("peer_id % 50 = 7")
    changes = own.withColumn("text", F.lit("changed")).union(own.select("peer_id").distinct().select("peer_id", F.lit(0), F.lit(5), F.lit("first"), F.lit("active")))

    def changed(tables):
        return {"messages": tables["messages"].join(changes, ["peer_id", "message_id"], "left_anti").unionByName(changes)}

    for _ in range(2):
        archive.update({"messages": changes.select("peer_id", "message_id")}, changed, "edits", 0)
    archive.compact("messages")
    return archive.read("messages")
