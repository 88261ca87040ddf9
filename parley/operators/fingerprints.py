"""Digests for incremental rebuilds, and the rows that pages and indexes are made of."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a message's digest covers.
CONTENT = ("message_id", "date", "sender_id", "text", "state", "edit_date", "reply_to_msg_id", "reply_to_peer_id", "grouped_id")


def config_fingerprint(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()


def message_digests(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(peer_id, message_id, date, digest): content and media, each row's by itself."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in CONTENT if c in messages.columns]
    rows, extra = messages, F.lit("")
    if links is not None:
        media = links.groupBy("peer_id", "message_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "media_id"))), lambda x: x["media_id"]), "\x1f").alias("_media"))
        rows, extra = messages.join(media, ["peer_id", "message_id"], "left"), F.coalesce("_media", F.lit(""))
    return rows.select("peer_id", "message_id", "date", F.sha2(F.concat_ws("\x1e", *content, extra), 256).alias("digest"))


def _combined(digests: DataFrame, keys: list[str]) -> DataFrame:
    """One digest a group, of the sum of its rows' digests: no list is collected, any order gives the same.

    The sum runs over four 60-bit parts, so it neither overflows nor depends on the partitioning.
    """
    parts = [F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"_p{k}") for k in range(4)]
    rows = digests.groupBy(*keys).agg(F.count("*").alias("n"), *parts)
    return rows.select(*keys, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"_p{k}").cast("string") for k in range(4))), 256).alias("fingerprint"))


def chat_fingerprint(messages: DataFrame, links: DataFrame | None = None, config: str = "") -> DataFrame:
    """A digest per chat of its messages, their media and the configuration."""
    rows = _combined(message_digests(messages, links), ["peer_id"])
    return rows.select("peer_id", F.col("n").alias("n_messages"), F.sha2(F.concat("fingerprint", F.lit(config)), 256).alias("fingerprint"))


def day_fingerprint(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    rows = message_digests(messages, links).withColumn("day", F.expr("date div 86400"))
    return _combined(rows, ["peer_id", "day"]).select("peer_id", "day", F.col("n").alias("n_messages"), "fingerprint")


def dataset_fingerprint(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row over all chats: number of chats and messages, and the digest of the chats' digests."""
    chats = chat_fingerprint(messages, links).withColumn("digest", F.sha2(F.concat(F.col("peer_id").cast("string"), F.lit(":"), F.col("fingerprint")), 256))
    total = chats.agg(F.sum("n_messages").alias("n_messages"))
    return _combined(chats, []).select(F.col("n").alias("n_chats"), "fingerprint").crossJoin(total)  # one row each


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Groups to rebuild: added, changed or removed."""
    rows = old.select(*keys, F.col("fingerprint").alias("_old")).join(new.select(*keys, F.col("fingerprint").alias("_new")), keys, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return rows.withColumn("change", change).where("change is not null").select(*keys, "change")


def page_rows(rows: DataFrame, keys: tuple[str, ...] = ("peer_id", "page_no")) -> DataFrame:
    """A page's messages in order. A page has a bounded number of messages, so the list is bounded."""
    rest = [c for c in rows.columns if c not in (*keys, "message_id")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("message_id", *rest))).alias("rows"))


def dialog_index(peers: DataFrame, messages: DataFrame, names: DataFrame) -> DataFrame:
    """The dialogs of an export: name, kind, messages, newest date; newest first."""
    active = messages.groupBy("peer_id").agg(F.count("*").alias("n_messages"), F.max("date").alias("last_date"))
    rows = peers.select("peer_id", "peer_type").join(names, "peer_id").join(active, "peer_id")
    return rows.orderBy(F.desc("last_date"), "peer_id")


def message_history(revisions: DataFrame) -> DataFrame:
    """Numbered versions with the time to show: the edit's, else when it was captured."""
    order = Window.partitionBy("peer_id", "message_id").orderBy("revision_no")
    return revisions.withColumn("version", F.concat(F.lit("v"), F.row_number().over(order).cast("string"))).withColumn("shown_at", F.coalesce("edit_date", "date"))
