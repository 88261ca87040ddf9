"""Joins between messages, peers and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import carried

#: Streaming manifests that are no picture or film of their own.
MANIFESTS = ("application/x-mpegURL", "application/vnd.apple.mpegurl")
PRIMARY_ROLES = ("attachment", "primary")


def message_media_items(links: DataFrame, media: DataFrame) -> DataFrame:
    """Each message's media in order of position."""
    rows = links.join(media.select("media_id", "kind", "download_status"), "media_id")
    items = F.sort_array(F.collect_list(F.struct("position", "media_id", "role", "kind", "download_status")))
    return rows.groupBy("peer_id", "message_id").agg(items.alias("items"))


def primary_media_items(links: DataFrame, media: DataFrame) -> DataFrame:
    """What a message shows: each object once, no manifests, and only one video, the first."""
    rows = links.where(F.col("role").isin(*PRIMARY_ROLES)).join(media.select("media_id", "kind", "mime_type"), "media_id")
    rows = rows.where(F.col("mime_type").isNull() | ~F.col("mime_type").isin(*MANIFESTS))
    rows = rows.groupBy("peer_id", "message_id", "media_id", "kind").agg(F.min("position").alias("position"))
    before = Window.partitionBy("peer_id", "message_id").orderBy("position", "media_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum((F.col("kind") == "video").cast("int")).over(before), F.lit(0))
    return rows.withColumn("_videos", seen).where("kind <> 'video' or _videos = 0").drop("_videos")


def referencing_messages(links: DataFrame, media: DataFrame) -> DataFrame:
    """For each object the messages that show it."""
    return links.join(media.select("media_id"), "media_id", "left_semi").groupBy("media_id").agg(F.count("*").alias("n_messages"), F.min(F.struct("peer_id", "message_id")).alias("f")).select("media_id", "n_messages", F.col("f.peer_id").alias("first_peer_id"), F.col("f.message_id").alias("first_message_id"))


def dialogs_with_activity(peers: DataFrame, messages: DataFrame) -> DataFrame:
    """Peers with messages and their newest date, newest first."""
    active = messages.groupBy("peer_id").agg(F.max("date").alias("last_activity"))
    return peers.join(active, "peer_id").orderBy(F.desc("last_activity"), F.desc("updated_at"), "peer_id")


def _target() -> Column:
    return F.coalesce("reply_to_peer_id", "peer_id")


def resolve_replies(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Every reply with its target's state and whether the target's chat is known."""
    replies = messages.where("reply_to_msg_id is not null").select("peer_id", "message_id", _target().alias("target_peer_id"), F.col("reply_to_msg_id").alias("target_message_id"))
    targets = messages.select(F.col("peer_id").alias("target_peer_id"), F.col("message_id").alias("target_message_id"), F.col("state").alias("target_state"))
    known = peers.select(F.col("peer_id").alias("target_peer_id"), F.lit(True).alias("peer_known"))
    rows = replies.join(targets, ["target_peer_id", "target_message_id"], "left").join(known, "target_peer_id", "left")
    return rows.select("peer_id", "message_id", "target_peer_id", "target_message_id", "target_state", F.coalesce("peer_known", F.lit(False)).alias("peer_known"))


def reply_edges(messages: DataFrame) -> DataFrame:
    """The reply table: source, target and resolved or missing."""
    replies = messages.where("reply_to_msg_id is not null").select(F.col("peer_id").alias("source_peer_id"), F.col("message_id").alias("source_message_id"), _target().alias("target_peer_id"), F.col("reply_to_msg_id").alias("target_message_id"))
    there = messages.select(F.col("peer_id").alias("target_peer_id"), F.col("message_id").alias("target_message_id"), F.lit("resolved").alias("found"))
    return replies.join(there, ["target_peer_id", "target_message_id"], "left").select("source_peer_id", "source_message_id", "target_peer_id", "target_message_id", F.coalesce("found", F.lit("missing")).alias("status"))


def reply_previews(messages: DataFrame, peers: DataFrame, snippet: Column) -> DataFrame:
    """For each reply the target's sender, snippet and state. snippet: an expression over the target's columns."""
    edges = reply_edges(messages)
    target = messages.select(F.col("peer_id").alias("target_peer_id"), F.col("message_id").alias("target_message_id"), F.col("sender_id").alias("target_sender_id"), F.col("state").alias("target_state"), snippet.alias("snippet"))
    names = peers.select(F.col("peer_id").alias("target_sender_id"), F.col("name").alias("target_sender"))
    return edges.join(target, ["target_peer_id", "target_message_id"], "left").join(names, "target_sender_id", "left").select("source_peer_id", "source_message_id", "target_peer_id", "target_message_id", "status", "target_state", "target_sender", "snippet")


def authoritative_names(peers: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """A chat's name: its own, else @username, else that of a title change, else `Chat id`."""
    good = lambda c: F.when((F.trim(c) != "") & (F.trim(c) != "Unknown"), F.trim(c))
    rows = peers if titles is None else peers.join(titles.select("peer_id", "title"), "peer_id", "left")
    title = F.lit(None).cast("string") if titles is None else F.col("title")
    at = F.when(F.trim("username") != "", F.concat(F.lit("@"), F.trim("username")))
    return rows.select("peer_id", F.coalesce(good(F.col("name")), at, good(title), F.concat(F.lit("Chat "), F.col("peer_id").cast("string"))).alias("display_name"))


def sender_names(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Each message's sender by name; a channel's posts are the channel's, other unsent ones `You`."""
    names = authoritative_names(peers)
    sender = names.select(F.col("peer_id").alias("sender_id"), F.col("display_name").alias("by_sender"))
    chat = names.join(peers.select("peer_id", "peer_type"), "peer_id").select("peer_id", "peer_type", F.col("display_name").alias("by_chat"))
    rows = messages.select("peer_id", "message_id", "sender_id").join(sender, "sender_id", "left").join(chat, "peer_id", "left")
    name = F.when(F.col("sender_id").isNotNull(), F.coalesce("by_sender", F.concat(F.lit("Chat "), F.col("sender_id").cast("string")))).when(F.col("peer_type") == "channel", F.col("by_chat")).otherwise(F.lit("You"))
    return rows.select("peer_id", "message_id", name.alias("sender_name"))


def forward_provenance(messages: DataFrame, peers: DataFrame, path: str = "forward_json") -> DataFrame:
    """Where a forwarded message comes from: source chat, its name, and whether it is in the archive."""
    source = F.coalesce(F.get_json_object(path, "$.from_id"), F.get_json_object(path, "$.saved_from_peer")).cast("long")
    rows = messages.where(F.col(path).isNotNull()).select("peer_id", "message_id", source.alias("source_peer_id"), F.coalesce(F.get_json_object(path, "$.from_name"), F.get_json_object(path, "$.post_author")).alias("said"))
    names = peers.select(F.col("peer_id").alias("source_peer_id"), "name", F.lit(True).alias("here"))
    return rows.join(names, "source_peer_id", "left").select("peer_id", "message_id", "source_peer_id", F.coalesce("name", "said", F.lit("Unknown")).alias("source_name"), F.coalesce("here", F.lit(False)).alias("archived"))


def orphan_media_links(links: DataFrame, messages: DataFrame, media: DataFrame) -> DataFrame:
    """Links whose message or object is missing, with the reason."""
    no_message = links.join(messages, ["peer_id", "message_id"], "left_anti").withColumn("reason", F.lit("message"))
    no_object = links.join(media, "media_id", "left_anti").select(*links.columns).withColumn("reason", F.lit("object"))
    return no_message.select(*links.columns, "reason").unionByName(no_object)


def messages_without_peer(messages: DataFrame, peers: DataFrame) -> DataFrame:
    return messages.select("peer_id").distinct().join(peers, "peer_id", "left_anti")


def edited_without_revision(messages: DataFrame, revisions: DataFrame) -> DataFrame:
    return messages.where("state = 'edited'").join(revisions, ["peer_id", "message_id"], "left_anti").select("peer_id", "message_id", "edit_date")


def chronology_inversions(messages: DataFrame, peers: DataFrame, slack: int = 86400) -> DataFrame:
    """Messages dated more than `slack` before the newest one with a smaller id, and that one; groups and channels only.

    A running maximum per chat, carried from range to range of ids: no pair is formed and no chat is one task.
    """
    rows = messages.join(peers.where(F.col("peer_type").isin("group", "channel")).select("peer_id"), "peer_id", "left_semi")
    dated = F.struct("date", (-F.col("message_id")).alias("m"))
    rows, block = carried(rows.select("peer_id", "message_id", "date"), ("peer_id",), _newest=(F.max(dated), F.max))
    rows = rows.withColumn("n", F.greatest(F.max(dated).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.col("_newest"))).where(F.col("n.date") > F.col("date") + slack)
    return rows.select("peer_id", "message_id", "date", (-F.col("n.m")).alias("earlier_id"), F.col("n.date").alias("earlier_date"))


def match_files(files: DataFrame, media: DataFrame) -> DataFrame:
    """Full join of a file inventory (rel_path, length, sha256, is_part) with completed objects, each pair classified.

    A size of 0 or null says nothing. Only verified objects are held to their digest; a file without one could not be
    read. Files of a path that is complete or being downloaded, and their parts, are in_use and no orphans.
    """
    plain = lambda c: F.regexp_replace(c, "^(media/)+", "")
    there = files.select(plain("rel_path").alias("path"), "rel_path", "length", F.col("sha256").alias("file_sha256"), "is_part")
    owned = media.where("local_rel_path is not null and download_status in ('completed', 'downloading')").select(plain("local_rel_path").alias("path"), "media_id", "size_bytes", "sha256", "verification_status", "download_status")
    known = owned.where("download_status = 'completed'").drop("download_status")
    base = F.regexp_replace("path", r"\.part$", "")
    pairs = known.join(there, "path", "full").withColumn("_base", F.when(F.col("media_id").isNull(), base))
    pairs = pairs.join(owned.select(F.col("path").alias("_base"), F.lit(True).alias("_used")).distinct(), "_base", "left")
    result = (
        F.when(F.col("media_id").isNull(), F.when(F.col("_used"), "in_use").when(F.col("is_part"), "orphan_part").otherwise("orphan_file")).when(F.col("rel_path").isNull(), "missing")
        .when((F.col("size_bytes") > 0) & (F.col("size_bytes") != F.col("length")), "size_mismatch").when(F.col("verification_status") != "verified", "unverified")
        .when(F.col("sha256").isNotNull() & F.col("file_sha256").isNull(), "unreadable").when(F.col("sha256") != F.col("file_sha256"), "hash_mismatch").otherwise("match")
    )
    return pairs.select("path", "media_id", "rel_path", result.alias("result"))


def range_hash_cover(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (media_id, start, end) whose hash ranges (media_id, offset, limit) tile them without a gap."""
    rows = ranges.join(chunks, "media_id").where("offset >= start and offset + limit <= end")
    order = Window.partitionBy("media_id", "start", "end").orderBy("offset")
    rows = rows.withColumn("gap", F.col("offset") != F.coalesce(F.lag(F.col("offset") + F.col("limit")).over(order), F.col("start")))
    rows = rows.groupBy("media_id", "start", "end").agg(F.count("*").alias("n_ranges"), F.bool_or("gap").alias("gap"), F.max(F.expr("offset + limit")).alias("reach"))
    return rows.select("media_id", "start", "end", "n_ranges", (~F.col("gap") & (F.col("reach") == F.col("end"))).alias("covered"))


def message_participants(messages: DataFrame) -> DataFrame:
    """(chat, participant): the chat itself and its senders."""
    return messages.select("peer_id", F.col("peer_id").alias("participant_id")).union(messages.where("sender_id is not null").select("peer_id", F.col("sender_id"))).distinct()


def foreign_key_violations(children: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """Rows of each child (name -> rows, keys, parent, parent's keys) without a parent, counted per child and key."""
    found = None
    for name, (rows, keys, parent, parent_keys) in children.items():
        there = parent.select(*(F.col(p).alias(k) for k, p in zip(keys, parent_keys))).distinct()
        part = rows.dropna(subset=keys).join(there, keys, "left_anti").agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("child"), F.lit(",".join(keys)).alias("key"), "n_violations")
        found = part if found is None else found.union(part)
    return found


def reaction_groups(reactions: DataFrame, peers: DataFrame) -> DataFrame:
    """Per message and reaction: count, chosen by me, and the reactors' names."""
    one = reactions.select("peer_id", "message_id", "reaction", "count", "chosen", F.explode_outer("reactors").alias("reactor_id"))
    names = peers.select(F.col("peer_id").alias("reactor_id"), F.col("name").alias("reactor"))
    return one.join(names, "reactor_id", "left").groupBy("peer_id", "message_id", "reaction").agg(F.max("count").alias("count"), F.bool_or("chosen").alias("chosen"), F.array_sort(F.collect_set("reactor")).alias("reactors"))


def missing_assets(wanted: DataFrame, files: DataFrame, key: str = "asset_id") -> DataFrame:
    """Wanted ids without a file, or with an empty one."""
    return wanted.select(key).distinct().join(files.where("length > 0"), key, "left_anti")


def missing_targets(messages: DataFrame) -> DataFrame:
    """Distinct reply targets that the archive lacks, by chat: what to fetch next."""
    wanted = messages.where("reply_to_msg_id is not null").select(_target().alias("peer_id"), F.col("reply_to_msg_id").alias("message_id")).distinct()
    return wanted.join(messages, ["peer_id", "message_id"], "left_anti").select("peer_id", "message_id")
