"""Change feeds as Structured Streaming jobs over a versioned archive.

A batch is applied as a whole: the new version of the tables is written, then the
pointer moves. The version's name carries the feed and the batch id, and the pointer a ledger of each feed's last
batch, so a batch that runs again after a crash finds its work done or does all of it anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import merge as m
from ..sources.readers import read_archive
from ..sources.schemas import ARCHIVE
from ..sources.writers import append, current_version, has_table, write_archive


def dedupe_updates(updates: DataFrame, keys: tuple[str, ...] = ("peer_id", "message_id", "seq"), time: str = "event_time", late: str = "1 day") -> DataFrame:
    """Replayed events go, in a batch or within the watermark of a stream."""
    if updates.isStreaming:
        return updates.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return updates.dropDuplicates(list(keys))


def blocked_slices(updates: DataFrame) -> DataFrame:
    """Slices with an unsupported event that affects state: they and all later ones of their chat must wait."""
    return updates.where("kind = 'unsupported' and affects_state").groupBy("peer_id").agg(F.min("slice_id").alias("blocked_from"))


def _stopped(updates: DataFrame, frozen: DataFrame | None) -> DataFrame:
    """updates with blocked_from: the first slice of their chat that must wait, null if none. All slices of a frozen chat must."""
    rows = updates.join(blocked_slices(updates), "peer_id", "left")
    if frozen is None:
        return rows
    rows = rows.join(frozen.select("peer_id", F.lit(True).alias("_frozen")).distinct(), "peer_id", "left")
    return rows.withColumn("blocked_from", F.when(F.col("_frozen"), F.least("slice_id", F.coalesce("blocked_from", "slice_id"))).otherwise(F.col("blocked_from"))).drop("_frozen")


READY = "blocked_from is null or slice_id < blocked_from"


def freeze_on_unsupported(updates: DataFrame, frozen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events to apply, dead letters): a chat stops before its first blocked slice; chats of frozen (peer_id) don't start."""
    ready = _stopped(updates, frozen).where(f"({READY}) and kind <> 'unsupported'").drop("blocked_from")
    return ready, updates.where("kind = 'unsupported'")


def apply_ready(tables: dict[str, DataFrame], ready: DataFrame, *order: str) -> dict[str, DataFrame]:
    """peers, messages and message_revisions after events that may be applied, a chat's in the order of those columns."""
    at = F.struct(*order)
    versions = ready.where("kind in ('new', 'edit')").withColumn("_at", at)
    numbered = versions.withColumn("seq", F.row_number().over(Window.partitionBy("peer_id", "message_id").orderBy("_at")).cast("long"))
    # events don't have all columns of a message: what they lack stays, and makes no revision
    columns = [c for c in tables["messages"].columns if c in numbered.columns]
    numbered = numbered.select(*columns, "seq")
    _, revisions = m.merge_messages(tables["messages"].select(*columns), numbered)
    messages = m.merge(tables["messages"], m.last_change(numbered, ["peer_id", "message_id"], ["seq"]).drop("seq"), ["peer_id", "message_id"], m.MESSAGES)
    last = ready.where("kind in ('new', 'edit', 'delete') and message_id is not null").groupBy("peer_id", "message_id").agg(F.max_by("kind", at).alias("kind"))
    messages = m.mark_deleted(messages, last.where("kind = 'delete'"))
    peers = m.last_change(ready.where("peer is not null").select("peer.*", *order), ["peer_id"], list(order)).drop(*order)
    return {"peers": m.merge_peers(tables["peers"], peers), "messages": messages, "message_revisions": revisions}


def apply_update_slice(tables: dict[str, DataFrame], updates: DataFrame) -> dict[str, DataFrame]:
    """peers, messages, message_revisions, sync_state, unsupported_events and pending_updates after a batch of events in order of (slice_id, seq).

    A chat that meets an unsupported event stays uncertain until recover_chats: its events from that slice on, and
    all of later batches, wait in pending_updates (if tables has those of earlier batches) and nothing is lost.
    """
    _, dead = freeze_on_unsupported(updates)
    events = updates.unionByName(tables["pending_updates"], allowMissingColumns=True) if "pending_updates" in tables else updates
    frozen = tables["sync_state"].where("uncertain").select("peer_id")
    ready, _ = freeze_on_unsupported(events, frozen)
    waiting = _stopped(events, frozen).where(f"not ({READY})").drop("blocked_from")
    merged = apply_ready(tables, ready, "slice_id", "seq")
    state = ready.groupBy("peer_id").agg(F.max("pts").cast("int").alias("pts"))
    stopped = waiting.select("peer_id", F.lit(True).alias("uncertain")).distinct()
    state = state.join(stopped, "peer_id", "full").select("peer_id", "pts", F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    return merged | {
        "sync_state": m.merge(tables["sync_state"], state, ["peer_id"], {"pts": m.COALESCE}),
        "unsupported_events": dead.select(F.concat_ws(":", "peer_id", "slice_id", "seq").alias("event_id"), "peer_id", "kind", "affects_state"),
        "pending_updates": waiting,
    }


def recover_chats(tables: dict[str, DataFrame], chats: DataFrame) -> dict[str, DataFrame]:
    """sync_state and pending_updates after chats (peer_id) were brought up to date by a snapshot.

    They aren't uncertain any more, and what of theirs waits, without the unsupported events, goes with the next batch.
    """
    done = chats.select("peer_id", F.lit(True).alias("_done")).distinct()
    state = tables["sync_state"].join(done, "peer_id", "left").withColumn("uncertain", F.when(F.col("_done"), F.lit(False)).otherwise(F.col("uncertain")))
    pending = tables["pending_updates"].join(done, "peer_id", "left").where("_done is null or kind <> 'unsupported'")
    return {"sync_state": state.select(*tables["sync_state"].columns), "pending_updates": pending.select(*tables["pending_updates"].columns)}


def stream_apply_updates(updates: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, stream: str | None = None):
    """Start a query that applies a feed to the archive below folder. Updates of a channel are keyed by it like any chat's.

    stream names the feed in the archive's ledger, so that several feeds can be applied to one archive, one after another; if
    it isn't given, the checkpoint's place is the name. parley.streaming.chats has a form that only rewrites what a batch touches.
    """
    spark, stream = updates.sparkSession, stream or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, batch_id: int) -> None:
        done, ledger = current_version(spark, folder)
        if ledger.get(stream, -1) >= batch_id:
            return
        tables = {t: read_archive(spark, folder, t) for t in ("peers", "messages", "sync_state")}
        if has_table(spark, folder, "pending_updates"):
            tables["pending_updates"] = spark.read.schema(batch.schema).parquet(f"{folder}/{done}/pending_updates")
        after = apply_update_slice(tables, batch)
        append(after["message_revisions"], f"{folder}/log/message_revisions", batch_id, stream)
        append(after["unsupported_events"], f"{folder}/log/unsupported_events", batch_id, stream)
        write_archive({t: after[t] for t in ("peers", "messages", "sync_state", "pending_updates")}, folder, f"{stream}-{batch_id}", ledger | {stream: batch_id})

    return updates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshot_reconcile(messages: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What a full snapshot has beyond the archive when the event window was lost: ids above each chat's newest."""
    newest = messages.groupBy("peer_id").agg(F.max("message_id").alias("_max"))
    return snapshot.join(newest, "peer_id", "left").where("_max is null or message_id > _max").drop("_max")


def history_progress(pages: DataFrame) -> DataFrame:
    """Pages of a descending backfill (peer_id, page_no, min_id, max_id) that don't get any further."""
    order = Window.partitionBy("peer_id").orderBy("page_no")
    return pages.withColumn("before", F.lag("min_id").over(order)).where("before is not null and min_id >= before").select("peer_id", "page_no", "min_id", "before")


def history_backfill(messages: DataFrame, source: DataFrame, start: int | None = None, end: int | None = None, peers: list[int] | None = None) -> DataFrame:
    """Messages of the source, within the dates and chats asked for, that the archive lacks."""
    from ..operators.lookups import date_range

    return date_range(source, start, end, peers).join(messages, ["peer_id", "message_id"], "left_anti")


def integrity_row(messages: DataFrame, sync_state: DataFrame, backlog: DataFrame, window_lost: bool, report_id: str, now: int) -> DataFrame:
    """The report of a sync run: lossless unless a window was lost or a chat is uncertain; complete unless a channel waits."""
    counts = sync_state.agg(F.count_if("uncertain").alias("n_uncertain")).crossJoin(backlog.agg(F.count_if(F.col("status") != "completed").alias("n_waiting"))).crossJoin(messages.agg(F.count("*").alias("n_messages")))  # one row each
    lossless = ~F.lit(window_lost) & (F.col("n_uncertain") == 0)
    return counts.select(F.lit(report_id).alias("report_id"), F.lit("account").alias("scope"), lossless.alias("lossless"), (lossless & (F.col("n_waiting") == 0)).alias("complete"), F.lit(window_lost).alias("event_window_lost"), "n_messages", F.lit(now).cast("long").alias("created_at"))


def full_sync_job(tables: dict[str, DataFrame], history: DataFrame, updates: DataFrame, backlog: DataFrame, now: int, report_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """History, then deltas, then the report: one batch job."""
    columns = tables["messages"].columns
    filled = history_backfill(tables["messages"], history).select(*(c for c in columns if c in history.columns))
    before = tables | {"messages": tables["messages"].unionByName(filled, allowMissingColumns=True)}
    after = apply_update_slice(before, updates)
    return after, integrity_row(after["messages"], after["sync_state"], backlog, False, report_id, now)


def activity_windows(messages: DataFrame, time: str, width: str = "1 day", slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ("peer_id",)) -> DataFrame:
    """Messages per window of time, tumbling or sliding, in batch or streaming."""
    rows = messages.withWatermark(time, late) if messages.isStreaming else messages
    return rows.groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def activity_sessions(messages: DataFrame, time: str, gap: str = "600 seconds", late: str = "1 day", keys: tuple[str, ...] = ("peer_id",)) -> DataFrame:
    """Runs of messages with less than `gap` between them."""
    rows = messages.withWatermark(time, late) if messages.isStreaming else messages
    return rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def pts_gaps(updates: DataFrame) -> DataFrame:
    """Events whose counter doesn't follow from the one before: pts - pts_count is not the previous pts."""
    order = Window.partitionBy("peer_id").orderBy("pts")
    return updates.withColumn("before", F.lag("pts").over(order)).where("before is not null and pts - pts_count > before").select("peer_id", "before", "pts", "pts_count")


def empty_table(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], ARCHIVE[name])
