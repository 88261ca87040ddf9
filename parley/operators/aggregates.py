"""One-pass aggregations over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The download states of a media object.
DOWNLOAD_STATES = ("pending", "downloading", "retry_wait", "skipped", "permanently_failed", "completed")
VERIFICATION_STATES = ("unverified", "verified", "corrupted_hash", "corrupted_size", "missing_file")


def count_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy("peer_id").agg(F.count("*").alias("n_messages"))


def message_bounds(messages: DataFrame) -> DataFrame:
    """Per chat the first and last id and the newest date."""
    return messages.groupBy("peer_id").agg(F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"), F.max("date").alias("last_date"))


def media_stats(media: DataFrame) -> DataFrame:
    """One row: total, a count per download and verification state, known and completed bytes."""
    states = [F.count_if(F.col("download_status") == s).alias(f"n_{s}") for s in DOWNLOAD_STATES]
    checks = [F.count_if(F.col("verification_status") == s).alias(f"n_{s}") for s in VERIFICATION_STATES]
    return media.agg(F.count("*").alias("total"), *states, *checks, F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("known_bytes"), F.coalesce(F.sum(F.when(F.col("download_status") == "completed", F.col("size_bytes"))), F.lit(0)).alias("completed_bytes"))


def queue_stats(media: DataFrame, now: int) -> DataFrame:
    """What waits for download: how many, their known bytes, and whether every size is known."""
    due = media.where((F.col("download_status") == "pending") | ((F.col("download_status") == "retry_wait") & (F.col("next_retry_at") <= now)))
    return due.agg(F.count("*").alias("eligible"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("expected_bytes"), (F.count_if(F.col("size_bytes").isNull()) == 0).alias("all_sizes_known"))


def media_kind_counts(links: DataFrame, media: DataFrame) -> DataFrame:
    """Distinct objects per chat and kind."""
    return links.join(media.select("media_id", "kind"), "media_id").groupBy("peer_id", "kind").agg(F.countDistinct("media_id").alias("n_media"))


def blocked_count(backlog: DataFrame, peers: list[int] | None = None) -> DataFrame:
    rows = backlog.where(F.col("status").isin("blocked", "failed"))
    rows = rows if peers is None else rows.where(F.col("peer_id").isin(peers))
    return rows.agg(F.count("*").alias("n_blocked"))


def distinct_custom_emoji(messages: DataFrame) -> DataFrame:
    """Sorted distinct custom emoji ids in entities_json and reactions_json."""
    entity = F.from_json("entities_json", "array<struct<custom_emoji_id:string>>")
    reaction = F.from_json("reactions_json", "struct<results:array<struct<reaction:struct<custom_emoji_id:string>>>>")
    both = messages.select(F.explode(F.concat(F.coalesce(F.transform(entity, lambda e: e["custom_emoji_id"]), F.array()), F.coalesce(F.transform(reaction["results"], lambda r: r["reaction"]["custom_emoji_id"]), F.array()))).alias("emoji_id"))
    return both.where("emoji_id is not null").distinct().orderBy("emoji_id")


def topic_summary(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Messages and newest date of each topic: pinned first, then the general one, then the newest."""
    found = messages.groupBy("peer_id", "topic_id").agg(F.count("*").alias("n_messages"), F.max("date").alias("last_date"))
    rows = topics.join(found, ["peer_id", "topic_id"], "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return rows.orderBy("peer_id", F.desc("pinned"), F.desc(F.col("topic_id") == 1), F.desc_nulls_last("last_date"), "topic_id")


def album_reactions(reactions: DataFrame) -> DataFrame:
    """Per album and reaction: counts added, chosen by anyone of its messages, distinct reactors."""
    return reactions.groupBy("peer_id", "album_id", "reaction").agg(F.sum("count").alias("count"), F.bool_or("chosen").alias("chosen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reactors")))).alias("reactors"))


def update_tally(updates: DataFrame) -> DataFrame:
    """Events and touched messages of each kind."""
    return updates.groupBy("kind").agg(F.count("*").alias("n_events"), F.countDistinct("peer_id", "message_id").alias("n_messages"))


def import_summary(messages: DataFrame) -> DataFrame:
    return messages.agg(F.countDistinct("peer_id").alias("chats"), F.count("*").alias("messages"), F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"), F.count_if(F.col("text").isNull()).alias("without_text"))


def export_summary(messages: DataFrame, links: DataFrame, page_size: int = 250) -> DataFrame:
    """Dialogs, messages, pages, deleted, edited and distinct media of an export."""
    per_chat = messages.groupBy("peer_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "deleted").alias("deleted"), F.count_if(F.col("state") == "edited").alias("edited"))
    chats = per_chat.agg(F.count("*").alias("dialogs"), F.sum("n").alias("messages"), F.sum(F.ceil(F.col("n") / page_size)).cast("long").alias("pages"), F.sum("deleted").alias("deleted"), F.sum("edited").alias("edited"))
    # both sides are one aggregated row each
    return chats.crossJoin(links.agg(F.countDistinct("media_id").alias("media")))


def shard_stats(entries: DataFrame) -> DataFrame:
    """Per shard of a search index: entries, chats (their number and ids, at most as many as a shard has entries), first and last date."""
    return entries.groupBy("shard_id").agg(F.count("*").alias("n_entries"), F.countDistinct("peer_id").alias("n_peers"), F.array_sort(F.collect_set("peer_id")).alias("peer_ids"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def self_name(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """The owner's name: the one sender, other than the contact, that all private chats share. No row unless it is unique."""
    private = peers.where("peer_type = 'user'").select("peer_id", F.lower("name").alias("contact"))
    names = messages.join(private, "peer_id").where("sender_name is not null and (contact is null or lower(sender_name) <> contact)").select("peer_id", F.lower("sender_name").alias("k"), "sender_name").distinct()
    chats = messages.join(private, "peer_id").agg(F.countDistinct("peer_id").alias("chats"))
    found = names.groupBy("k").agg(F.countDistinct("peer_id").alias("n"), F.min("sender_name").alias("self_name")).crossJoin(F.broadcast(chats)).where("n = chats")
    return found.agg(F.count("*").alias("n"), F.min("self_name").alias("self_name")).where("n = 1").select("self_name")


def chat_updated_at(messages: DataFrame) -> DataFrame:
    return messages.groupBy("peer_id").agg(F.max("date").alias("updated_at"))
