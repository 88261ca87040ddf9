"""Queries: lookups, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, lookups
from .registry import query

NOW = 1700003600
TARGET = "coalesce(reply_to_peer_id, peer_id)"


@query("p1_get_message", "SELECT peer_id, message_id, date, text, state FROM messages WHERE message_id = 100")
def _(a):
    return lookups.get_rows(a.messages, message_id=100).select("peer_id", "message_id", "date", "text", "state")


@query("p2_list_messages", "SELECT message_id, date, state FROM messages WHERE peer_id = 1 AND message_id > 10 ORDER BY message_id LIMIT 20")
def _(a):
    return lookups.list_messages(a.messages, 1, 20, after=10).select("message_id", "date", "state")


@query("p3_list_message_dates", "SELECT message_id, date FROM messages WHERE peer_id = 4")
def _(a):
    return lookups.list_message_dates(a.messages, 4)


@query("p5_list_peers", "SELECT peer_id, name, updated_at FROM peers WHERE peer_type = 'group' ORDER BY updated_at DESC, peer_id LIMIT 25")
def _(a):
    return lookups.list_peers(a.peers, "group", 25).select("peer_id", "name", "updated_at")


@query("p6_list_by_peer_type", "SELECT peer_id FROM peers WHERE peer_type IN ('user', 'group')")
def _(a):
    return lookups.peers_of_kind(a.peers, channels=False)


@query("p7_date_range", "SELECT peer_id, message_id, date FROM messages WHERE date >= 820454400 AND date <= 851990400")
def _(a):
    return lookups.date_range(a.messages, 820454400, 851990400).select("peer_id", "message_id", "date")


@query("p8_visible_messages", "SELECT peer_id, count(*) AS n FROM messages WHERE NOT is_service AND state <> 'deleted' GROUP BY peer_id")
def _(a):
    return lookups.visible_messages(a.messages, include_service=False).groupBy("peer_id").agg(F.count("*").alias("n"))


@query("p9_media_by_status", "SELECT media_id, created_at FROM media_objects WHERE download_status = 'skipped'")
def _(a):
    return lookups.media_by_status(a.media, "skipped").select("media_id", "created_at")


@query("p9_media_by_hash", "SELECT sha256, min(media_id) AS media_id FROM media_objects WHERE download_status = 'completed' AND sha256 IS NOT NULL GROUP BY sha256")
def _(a):
    return lookups.media_by_hash(a.media)


def _titled(a):
    """One message in seven announces a title."""
    said = F.when(F.col("message_id") % 7 == 0, F.concat(F.lit('Changed group title to: "'), F.coalesce("text", F.lit("?")), F.lit('"'))).otherwise(F.col("text"))
    return a.messages.withColumn("text", said)


@query("p10_creation_or_title_change", """
SELECT peer_id, message_id, title FROM (
  SELECT peer_id, message_id, coalesce(text, '?') AS title, row_number() OVER (PARTITION BY peer_id ORDER BY message_id) AS k FROM messages WHERE message_id % 7 = 0) WHERE k = 1
""")
def _(a):
    return lookups.title_changes(_titled(a), ('Created group "', 'Created channel "', "Changed group title to:"))


@query("p12_latest_report", """
SELECT peer_id, seq, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY seq DESC) AS k FROM feed) WHERE k = 1
""")
def _(a):
    return lookups.latest_per(a.feed.select("peer_id", "seq", "kind", "text"), ["peer_id"], "seq")


@query("p13_sync_watermark", "SELECT peer_id, max(seq) AS pts, max(date) AS date FROM feed GROUP BY peer_id")
def _(a):
    return a.feed.groupBy("peer_id").agg(F.max("seq").alias("pts"), F.max("date").alias("date"))


@query("t2_download_worklist", f"""
SELECT media_id, download_status, retry_count, created_at FROM media_objects
WHERE download_status = 'pending' OR (download_status = 'retry_wait' AND (next_retry_at % 5 = 0 OR next_retry_at <= {NOW - 1800}))
ORDER BY CASE WHEN download_status = 'pending' THEN 0 ELSE 1 END, retry_count, created_at, media_id LIMIT 100
""")
def _(a):
    """One retry in five has no time."""
    return lookups.download_worklist(a.media.withColumn("next_retry_at", F.when(F.col("next_retry_at") % 5 != 0, F.col("next_retry_at"))), NOW - 1800, 100)


@query("t5_best_photo_size", """
SELECT l_orderkey AS photo_id, l_linenumber AS ordinal, l_partkey % 97 AS width, l_suppkey % 89 AS height, l_partkey % 5 AS bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 97) * (l_suppkey % 89) DESC, l_partkey % 5 DESC, l_linenumber, l_partkey % 97 DESC) AS k FROM lineitem) WHERE k = 1
""")
def _(a):
    sizes = a.table("lineitem").selectExpr("l_orderkey AS photo_id", "l_linenumber AS ordinal", "l_partkey % 97 AS width", "l_suppkey % 89 AS height", "l_partkey % 5 AS bytes")
    return lookups.best_photo_size(sizes, ["photo_id"])


@query("j1_message_media_items", """
SELECT peer_id, message_id, count(*) AS n_items, string_agg(media_id, ',' ORDER BY position, media_id) AS ids
FROM message_media JOIN media_objects USING (media_id) GROUP BY peer_id, message_id
""")
def _(a):
    return joins.message_media_items(a.links, a.media).select("peer_id", "message_id", F.size("items").cast("long").alias("n_items"), F.array_join("items.media_id", ",").alias("ids"))


@query("j2_primary_media_items", """
WITH r AS (SELECT peer_id, message_id, media_id, kind, min(position) AS position FROM message_media JOIN media_objects USING (media_id)
    WHERE mime_type IS NULL OR mime_type NOT IN ('application/x-mpegURL', 'application/vnd.apple.mpegurl') GROUP BY ALL),
 v AS (SELECT *, coalesce(sum(CASE WHEN kind = 'video' THEN 1 ELSE 0 END) OVER (PARTITION BY peer_id, message_id ORDER BY position, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM r)
SELECT peer_id, message_id, media_id, kind, position FROM v WHERE kind <> 'video' OR seen = 0
""")
def _(a):
    return joins.primary_media_items(a.links, a.media)


@query("j3_referencing_messages", """
SELECT media_id, count(*) AS n_messages, first(peer_id ORDER BY peer_id, message_id) AS first_peer_id, first(message_id ORDER BY peer_id, message_id) AS first_message_id
FROM message_media WHERE media_id IN (SELECT media_id FROM media_objects) GROUP BY media_id
""")
def _(a):
    return joins.referencing_messages(a.links, a.media)


@query("j4_dialogs_with_activity", "SELECT p.*, m.last_activity FROM peers p JOIN (SELECT peer_id, max(date) AS last_activity FROM messages GROUP BY peer_id) m USING (peer_id)")
def _(a):
    return joins.dialogs_with_activity(a.peers, a.messages)


@query("j5_resolve_replies", f"""
SELECT m.peer_id, m.message_id, {TARGET.replace('peer_id)', 'm.peer_id)').replace('reply', 'm.reply')} AS target_peer_id, m.reply_to_msg_id AS target_message_id, t.state AS target_state, p.peer_id IS NOT NULL AS peer_known
FROM messages m LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id
LEFT JOIN peers p ON p.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) WHERE m.reply_to_msg_id IS NOT NULL
""")
def _(a):
    return joins.resolve_replies(a.messages, a.peers)


@query("j6_reply_edges", """
SELECT m.peer_id AS source_peer_id, m.message_id AS source_message_id, coalesce(m.reply_to_peer_id, m.peer_id) AS target_peer_id, m.reply_to_msg_id AS target_message_id,
 CASE WHEN t.message_id IS NULL THEN 'missing' ELSE 'resolved' END AS status
FROM messages m LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id WHERE m.reply_to_msg_id IS NOT NULL
""")
def _(a):
    return joins.reply_edges(a.messages)


NAMES_SQL = "SELECT peer_id, peer_type, coalesce(name, '@' || username, 'Chat ' || CAST(peer_id AS VARCHAR)) AS display_name FROM peers"


@query("j7_reply_previews", """
SELECT m.peer_id AS source_peer_id, m.message_id AS source_message_id, coalesce(m.reply_to_peer_id, m.peer_id) AS target_peer_id, m.reply_to_msg_id AS target_message_id,
 CASE WHEN t.message_id IS NULL THEN 'missing' ELSE 'resolved' END AS status, t.state AS target_state, p.name AS target_sender,
 CASE WHEN t.message_id IS NULL THEN NULL WHEN t.state = 'deleted' THEN 'Deleted message' ELSE coalesce(t.text, 'Attachment') END AS snippet
FROM messages m LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id
LEFT JOIN peers p ON p.peer_id = t.sender_id WHERE m.reply_to_msg_id IS NOT NULL
""")
def _(a):
    from ..functions.text import reply_snippet

    return joins.reply_previews(a.messages, a.peers, reply_snippet("text", "state"))


@query("j8_authoritative_names", f"SELECT peer_id, display_name FROM ({NAMES_SQL})")
def _(a):
    return joins.authoritative_names(a.peers)


@query("j9_sender_names", f"""
WITH n AS ({NAMES_SQL})
SELECT m.peer_id, m.message_id, CASE WHEN m.sender_id IS NOT NULL THEN coalesce(s.display_name, 'Chat ' || CAST(m.sender_id AS VARCHAR)) WHEN c.peer_type = 'channel' THEN c.display_name ELSE 'You' END AS sender_name
FROM messages m LEFT JOIN n s ON s.peer_id = m.sender_id LEFT JOIN n c ON c.peer_id = m.peer_id
""")
def _(a):
    return joins.sender_names(a.messages, a.peers)


@query("j10_forward_provenance", """
SELECT m.peer_id, m.message_id, m.message_id % 200 AS source_peer_id, coalesce(p.name, 'said ' || CAST(m.message_id % 9 AS VARCHAR)) AS source_name, p.peer_id IS NOT NULL AS archived
FROM messages m LEFT JOIN peers p ON p.peer_id = m.message_id % 200 WHERE m.message_id % 5 = 0
""")
def _(a):
    said = F.when(F.col("message_id") % 5 == 0, F.format_string('{"from_id": "%d", "from_name": "said %d"}', F.col("message_id") % 200, F.col("message_id") % 9))
    return joins.forward_provenance(a.messages.withColumn("forward_json", said), a.peers)


@query("j11_orphan_media_links", """
SELECT l.*, 'object' AS reason FROM message_media l WHERE media_id NOT IN (SELECT media_id FROM media_objects)
UNION ALL SELECT l.*, 'message' FROM message_media l WHERE message_id % 7 = 0
""")
def _(a):
    return joins.orphan_media_links(a.links, a.messages.where("message_id % 7 <> 0"), a.media)


@query("j12_messages_without_peer", "SELECT DISTINCT peer_id FROM messages WHERE peer_id NOT IN (SELECT peer_id FROM peers)")
def _(a):
    return joins.messages_without_peer(a.messages, a.peers)


@query("j13_edited_without_revision", "SELECT peer_id, message_id, edit_date FROM messages WHERE state = 'edited' AND message_id % 2 <> 0")
def _(a):
    return joins.edited_without_revision(a.messages, a.messages.where("message_id % 2 = 0").select("peer_id", "message_id"))


@query("j14_chronology_inversions", """
WITH r AS (SELECT peer_id, message_id, date FROM messages WHERE peer_id IN (SELECT peer_id FROM peers WHERE peer_type IN ('group', 'channel'))),
 w AS (SELECT *, max(date) OVER (PARTITION BY peer_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_date FROM r)
SELECT w.peer_id, w.message_id, w.date, (SELECT min(r.message_id) FROM r WHERE r.peer_id = w.peer_id AND r.message_id < w.message_id AND r.date = w.earlier_date) AS earlier_id, w.earlier_date
FROM w WHERE earlier_date > date + 86400
""")
def _(a):
    return joins.chronology_inversions(a.messages, a.peers)


@query("j15_match_files", """
WITH f AS (SELECT CAST(p_partkey AS VARCHAR) || '.bin' AS path, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'media/' ELSE '' END || CAST(p_partkey AS VARCHAR) || '.bin' AS rel_path FROM part WHERE p_partkey % 4 <> 0),
 m AS (SELECT replace(local_rel_path, 'media/', '') AS path, media_id, size_bytes, sha256, verification_status FROM media_objects WHERE download_status = 'completed' AND local_rel_path IS NOT NULL)
SELECT coalesce(m.path, f.path) AS path, m.media_id, f.rel_path,
 CASE WHEN m.media_id IS NULL THEN CASE WHEN f.p_partkey % 2 = 0 THEN 'orphan_part' ELSE 'orphan_file' END WHEN f.rel_path IS NULL THEN 'missing'
  WHEN m.size_bytes <> 10240 THEN 'size_mismatch' WHEN m.verification_status <> 'verified' THEN 'unverified' WHEN m.sha256 <> 'h' || CAST(f.p_partkey % 250 AS VARCHAR) THEN 'hash_mismatch' ELSE 'match' END AS result
FROM m FULL JOIN f ON m.path = f.path
""")
def _(a):
    k = F.col("p_partkey").cast("string")
    files = a.table("part").where("p_partkey % 4 <> 0").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "media/").otherwise(""), k, F.lit(".bin")).alias("rel_path"), F.lit(10240).cast("long").alias("length"), F.concat(F.lit("h"), (F.col("p_partkey") % 250).cast("string")).alias("sha256"), (F.col("p_partkey") % 2 == 0).alias("is_part"))
    return joins.match_files(files, a.media)


@query("j16_range_hash_cover", """
WITH r AS (SELECT l_orderkey AS media_id, (l_linenumber - 1) * 100 AS o, l_linenumber * 100 AS e FROM lineitem WHERE l_quantity > 3), t AS (SELECT o_orderkey AS media_id FROM orders),
 x AS (SELECT *, o <> coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY o), 0) AS gap FROM r JOIN t USING (media_id) WHERE e <= 300)
SELECT media_id, 0 AS start, 300 AS "end", count(*) AS n_ranges, NOT bool_or(gap) AND max(e) = 300 AS covered FROM x GROUP BY media_id
""")
def _(a):
    ranges = a.table("lineitem").where("l_quantity > 3").selectExpr("l_orderkey AS media_id", "CAST((l_linenumber - 1) * 100 AS INT) AS offset", "100 AS limit")
    return joins.range_hash_cover(ranges, a.table("orders").selectExpr("o_orderkey AS media_id", "0 AS start", "300 AS end"))


@query("j17_message_participants", "SELECT peer_id, peer_id AS participant_id FROM messages UNION SELECT peer_id, sender_id FROM messages WHERE sender_id IS NOT NULL")
def _(a):
    return joins.message_participants(a.messages)


@query("j18_foreign_key_violations", """
SELECT 'links' AS child, 'media_id' AS key, count(*) AS n_violations FROM message_media WHERE media_id NOT IN (SELECT media_id FROM media_objects)
UNION ALL SELECT 'messages', 'peer_id', count(*) FROM messages WHERE peer_id NOT IN (SELECT peer_id FROM peers)
""")
def _(a):
    return joins.foreign_key_violations({"links": (a.links, ["media_id"], a.media, ["media_id"]), "messages": (a.messages, ["peer_id"], a.peers, ["peer_id"])})


def _reactions(a):
    one = a.table("lineitem").join(a.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return one.select(F.col("o_custkey").alias("peer_id"), F.col("l_orderkey").alias("message_id"), F.concat(F.lit("r"), (F.col("l_partkey") % 4).cast("string")).alias("reaction"), F.col("l_linenumber").cast("long").alias("count"), (F.col("l_suppkey") % 5 == 0).alias("chosen"), F.array((F.col("l_suppkey") % 100).cast("long")).alias("reactors"), (F.col("l_orderkey") % 50).alias("album_id"))


@query("j19_reaction_groups", """
SELECT o_custkey AS peer_id, l_orderkey AS message_id, 'r' || CAST(l_partkey % 4 AS VARCHAR) AS reaction, max(CAST(l_linenumber AS BIGINT)) AS count, bool_or(l_suppkey % 5 = 0) AS chosen,
 coalesce(string_agg(DISTINCT p.name, ',' ORDER BY p.name), '') AS reactors
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN peers p ON p.peer_id = l_suppkey % 100 GROUP BY ALL
""")
def _(a):
    return joins.reaction_groups(_reactions(a), a.peers).withColumn("reactors", F.array_join("reactors", ","))


@query("j20_missing_assets", "SELECT DISTINCT media_id AS asset_id FROM message_media WHERE media_id NOT IN (SELECT media_id FROM media_objects WHERE size_bytes > 20480)")
def _(a):
    return joins.missing_assets(a.links.select(F.col("media_id").alias("asset_id")), a.media.select(F.col("media_id").alias("asset_id"), F.when(F.col("size_bytes") > 20480, F.col("size_bytes")).otherwise(0).alias("length")))


@query("j21_missing_targets", """
SELECT DISTINCT coalesce(m.reply_to_peer_id, m.peer_id) AS peer_id, m.reply_to_msg_id AS message_id FROM messages m
LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id WHERE m.reply_to_msg_id IS NOT NULL AND t.peer_id IS NULL
""")
def _(a):
    return joins.missing_targets(a.messages)


@query("a1_count_messages", "SELECT peer_id, count(*) AS n_messages FROM messages GROUP BY peer_id")
def _(a):
    return agg.count_messages(a.messages)


@query("a2_message_bounds", "SELECT peer_id, min(message_id) AS min_id, max(message_id) AS max_id, max(date) AS last_date FROM messages GROUP BY peer_id")
def _(a):
    return agg.message_bounds(a.messages)


@query("a3_media_stats", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE download_status = '{s}') AS n_{s}" for s in agg.DOWNLOAD_STATES) + ", " + ", ".join(f"count(*) FILTER (WHERE verification_status = '{s}') AS n_{s}" for s in agg.VERIFICATION_STATES) + ", CAST(sum(size_bytes) AS BIGINT) AS known_bytes, CAST(sum(size_bytes) FILTER (WHERE download_status = 'completed') AS BIGINT) AS completed_bytes FROM media_objects")
def _(a):
    return agg.media_stats(a.media)


@query("a4_queue_stats", f"SELECT count(*) AS eligible, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS expected_bytes, count(*) FILTER (WHERE size_bytes IS NULL) = 0 AS all_sizes_known FROM media_objects WHERE download_status = 'pending' OR (download_status = 'retry_wait' AND next_retry_at <= {NOW - 1800})")
def _(a):
    return agg.queue_stats(a.media, NOW - 1800)


@query("a5_media_kind_counts", "SELECT peer_id, kind, count(DISTINCT media_id) AS n_media FROM message_media JOIN media_objects USING (media_id) GROUP BY peer_id, kind")
def _(a):
    return agg.media_kind_counts(a.links, a.media)


BACKLOG_SQL = "SELECT peer_id, CASE WHEN peer_id % 5 = 0 THEN 'blocked' WHEN peer_id % 7 = 0 THEN 'failed' ELSE 'pending' END AS status, updated_at FROM peers WHERE peer_type = 'channel'"


def _backlog(a):
    return a.peers.where("peer_type = 'channel'").select("peer_id", F.when(F.col("peer_id") % 5 == 0, "blocked").when(F.col("peer_id") % 7 == 0, "failed").otherwise("pending").alias("status"), "updated_at")


@query("a6_blocked_count", f"SELECT count(*) AS n_blocked FROM ({BACKLOG_SQL}) WHERE status IN ('blocked', 'failed')")
def _(a):
    return agg.blocked_count(_backlog(a))


@query("p11_blocked_backlog", f"SELECT peer_id, status FROM ({BACKLOG_SQL}) WHERE status = 'blocked'")
def _(a):
    return lookups.get_rows(_backlog(a), status="blocked").select("peer_id", "status").orderBy("peer_id")


@query("t3_next_backlog", f"SELECT peer_id FROM ({BACKLOG_SQL}) WHERE status = 'pending' ORDER BY updated_at, peer_id LIMIT 10")
def _(a):
    return lookups.get_rows(_backlog(a), status="pending").orderBy("updated_at", "peer_id").limit(10).select("peer_id")


@query("a7_distinct_custom_emoji", "SELECT DISTINCT 'e' || CAST(message_id % 37 AS VARCHAR) AS emoji_id FROM messages WHERE message_id % 2 = 0 UNION SELECT DISTINCT 'x' || CAST(message_id % 41 AS VARCHAR) FROM messages WHERE message_id % 3 = 0")
def _(a):
    rows = a.messages.select(
        F.when(F.col("message_id") % 2 == 0, F.format_string('[{"type": "custom", "custom_emoji_id": "e%d"}, {"type": "bold"}]', F.col("message_id") % 37)).alias("entities_json"),
        F.when(F.col("message_id") % 3 == 0, F.format_string('{"results": [{"reaction": {"custom_emoji_id": "x%d"}, "count": 2}]}', F.col("message_id") % 41)).alias("reactions_json"),
    )
    return agg.distinct_custom_emoji(rows)


@query("a9_album_reactions", """
SELECT o_custkey AS peer_id, l_orderkey % 50 AS album_id, 'r' || CAST(l_partkey % 4 AS VARCHAR) AS reaction, CAST(sum(l_linenumber) AS BIGINT) AS count, bool_or(l_suppkey % 5 = 0) AS chosen, count(DISTINCT l_suppkey % 100) AS n_reactors
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
""")
def _(a):
    return agg.album_reactions(_reactions(a)).select("peer_id", "album_id", "reaction", "count", "chosen", F.size("reactors").cast("long").alias("n_reactors"))


@query("a10_reply_metrics", """
SELECT count(*) AS total, count(*) FILTER (WHERE t.state IN ('active', 'edited')) AS resolved, count(*) FILTER (WHERE t.state = 'deleted') AS unavailable, count(*) FILTER (WHERE t.state IS NULL) AS missing,
 count(*) FILTER (WHERE coalesce(m.reply_to_peer_id, m.peer_id) <> m.peer_id) AS cross_peer, count(*) FILTER (WHERE m.reply_to_msg_id = m.message_id AND coalesce(m.reply_to_peer_id, m.peer_id) = m.peer_id) AS self_replies,
 count(*) FILTER (WHERE p.peer_id IS NULL) AS out_of_scope
FROM messages m LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id
LEFT JOIN peers p ON p.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) WHERE m.reply_to_msg_id IS NOT NULL
""")
def _(a):
    rows = joins.resolve_replies(a.messages, a.peers)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("target_state").isin("active", "edited")).alias("resolved"), F.count_if(F.col("target_state") == "deleted").alias("unavailable"), F.count_if(F.col("target_state").isNull()).alias("missing"),
        F.count_if(F.col("target_peer_id") != F.col("peer_id")).alias("cross_peer"), F.count_if((F.col("target_peer_id") == F.col("peer_id")) & (F.col("target_message_id") == F.col("message_id"))).alias("self_replies"), F.count_if(~F.col("peer_known")).alias("out_of_scope"),
    )


@query("a13_update_tally", "SELECT kind, count(*) AS n_events, count(DISTINCT (peer_id, message_id)) AS n_messages FROM feed GROUP BY kind")
def _(a):
    return agg.update_tally(a.feed)


@query("a14_import_summary", "SELECT count(DISTINCT peer_id) AS chats, count(*) AS messages, min(message_id) AS min_id, max(message_id) AS max_id, count(*) FILTER (WHERE text IS NULL) AS without_text FROM messages")
def _(a):
    return agg.import_summary(a.messages)


@query("a15_export_summary", """
SELECT count(*) AS dialogs, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(ceil(n / 250.0)) AS BIGINT) AS pages, CAST(sum(d) AS BIGINT) AS deleted, CAST(sum(e) AS BIGINT) AS edited, (SELECT count(DISTINCT media_id) FROM message_media) AS media
FROM (SELECT peer_id, count(*) AS n, count(*) FILTER (WHERE state = 'deleted') AS d, count(*) FILTER (WHERE state = 'edited') AS e FROM messages GROUP BY peer_id)
""")
def _(a):
    return agg.export_summary(a.messages, a.links)


@query("a17_self_name", """
WITH s AS (SELECT m.peer_id, CASE WHEN m.k = 1 THEN 'Owner' ELSE 'n' || CAST(m.message_id % 50 AS VARCHAR) END AS sender_name FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY message_id) AS k FROM messages) m),
 r AS (SELECT s.peer_id, lower(s.sender_name) AS k, s.sender_name FROM s JOIN peers p USING (peer_id) WHERE p.peer_type = 'user' AND (p.name IS NULL OR lower(s.sender_name) <> lower(p.name)))
SELECT min(sender_name) AS self_name FROM (SELECT k, min(sender_name) AS sender_name FROM r GROUP BY k HAVING count(DISTINCT peer_id) = (SELECT count(DISTINCT s.peer_id) FROM s JOIN peers p USING (peer_id) WHERE p.peer_type = 'user')) HAVING count(*) = 1
""")
def _(a):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("peer_id").orderBy("message_id"))
    rows = a.messages.withColumn("sender_name", F.when(k == 1, "Owner").otherwise(F.concat(F.lit("n"), (F.col("message_id") % 50).cast("string"))))
    return agg.self_name(rows, a.peers)


@query("a18_chat_updated_at", "SELECT peer_id, max(date) AS updated_at FROM messages GROUP BY peer_id")
def _(a):
    return agg.chat_updated_at(a.messages)
