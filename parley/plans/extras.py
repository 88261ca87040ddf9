"""Queries: the remaining listings, merges, searches and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import audit, fingerprints, joins, lookups, search
from ..operators import merge as m
from ..sources import readers
from .registry import query
from .retrieval import POSTINGS


@query("p4_list_revisions", "SELECT seq AS revision_no, text, date FROM feed WHERE kind = 'edit' AND peer_id = 5 AND message_id = 3")
def _(a):
    rows = a.feed.where("kind = 'edit'").selectExpr("peer_id", "message_id", "seq AS revision_no", "text", "date")
    return lookups.list_revisions(rows, 5, 3).select("revision_no", "text", "date")


@query("p11_tombstones", "SELECT message_id, min(date) AS observed_at FROM feed WHERE kind = 'delete' GROUP BY message_id")
def _(a):
    return a.feed.where("kind = 'delete'").groupBy("message_id").agg(F.min("date").alias("observed_at")).orderBy("message_id")


@query("m14_merge_baseline", "SELECT peer_id AS baseline_id, max(seq) AS pts, CASE WHEN peer_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM feed GROUP BY peer_id")
def _(a):
    base = a.feed.groupBy(F.col("peer_id").alias("baseline_id")).agg(F.max("seq").alias("pts"), F.lit("running").alias("status"))
    done = base.where("baseline_id % 2 = 0").select("baseline_id", F.lit("completed").alias("status"))
    return m.merge(base, done, ["baseline_id"], m.BASELINE)


@query("m15_merge_replies", """
WITH b AS (SELECT peer_id, message_id, reply_to_msg_id AS target FROM messages WHERE message_id % 2 = 0), c AS (SELECT peer_id, message_id, coalesce(reply_to_msg_id, 0) + 1 AS target FROM messages WHERE message_id % 3 = 0)
SELECT coalesce(c.peer_id, b.peer_id) AS peer_id, coalesce(c.message_id, b.message_id) AS message_id, CASE WHEN c.peer_id IS NULL THEN b.target ELSE c.target END AS target FROM b FULL JOIN c ON b.peer_id = c.peer_id AND b.message_id = c.message_id
""")
def _(a):
    base = a.messages.where("message_id % 2 = 0").select("peer_id", "message_id", F.col("reply_to_msg_id").alias("target"))
    change = a.messages.where("message_id % 3 = 0").selectExpr("peer_id", "message_id", "coalesce(reply_to_msg_id, 0) + 1 AS target")
    return m.merge(base, change, ["peer_id", "message_id"], m.REPLIES)


@query("f3_search", """
WITH w AS (SELECT peer_id, message_id, date, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS toks FROM messages WHERE state IN ('active', 'edited') AND text IS NOT NULL),
 p AS (SELECT peer_id, message_id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'urgent')) AS tf FROM w), s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE tf > 0) AS df FROM p)
SELECT peer_id, message_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS rank FROM p JOIN messages m USING (peer_id, message_id), s WHERE tf > 0 AND m.date >= 820454400 AND m.sender_id = 7
""")
def _(a):
    found = search.search_messages(a.messages, search.build_postings(a.messages), "Urgent", sender=7, start=820454400, limit=None)
    return found.select("peer_id", "message_id", F.round("rank", 6).alias("rank"))


@query("f5_query_language", f"WITH {POSTINGS}, h AS (SELECT doc_id, bool_or(token = 'the') AS t, bool_or(token = 'und' OR starts_with(token, 'tha')) AS u, bool_or(token = 'is') AS i FROM p GROUP BY doc_id) SELECT doc_id FROM h WHERE t AND u AND NOT i")
def _(a):
    return search.match_query(search.build_postings(a.table("documents").select("doc_id", "text"), ("doc_id",)), "the und OR tha* NOT is", ("doc_id",))


@query("f6_snippet", "SELECT peer_id, message_id, replace(text, 'note', '<b>note</b>') AS shown FROM messages WHERE text IS NOT NULL")
def _(a):
    return a.messages.where("text is not null").select("peer_id", "message_id", search.snippet("text", ["note"]).alias("shown"))


@query("r16_export_bundle", """
SELECT code, 'html_export' AS category, 'error' AS severity, count(*) AS n FROM (SELECT DISTINCT peer_id, unnest(CASE peer_id % 4 WHEN 0 THEN ['HTML_MANIFEST_EMPTY_SOURCE_FINGERPRINT', 'HTML_SOURCE_FINGERPRINT_MISMATCH'] WHEN 1 THEN ['HTML_SOURCE_FINGERPRINT_MISMATCH'] WHEN 2 THEN ['HTML_MANIFEST_EMPTY_CONFIG_FINGERPRINT'] ELSE [] END) AS code FROM messages) GROUP BY code
""")
def _(a):
    now = fingerprints.chat_fingerprint(a.messages)
    k = F.col("peer_id") % 4
    manifest = now.select("peer_id", F.when(k == 0, "").when(k == 1, "old").otherwise(F.col("fingerprint")).alias("source_fingerprint"), F.when(k != 2, "c").alias("config_fingerprint"))
    return audit.audit(audit.Tables(export_manifest=manifest, fingerprints=now), ("export",)).groupBy("code", "category", "severity").agg(F.count("*").alias("n"))


@query("r16_export_files", """
SELECT CASE peer_id % 5 WHEN 0 THEN 'HTML_EXPORT_DIR_MISSING' WHEN 1 THEN 'HTML_MANIFEST_MISSING' ELSE 'HTML_MANIFEST_CORRUPTED' END AS code, 'html_export' AS category, CASE peer_id % 5 WHEN 0 THEN 'fatal' ELSE 'error' END AS severity, count(*) AS n FROM peers WHERE peer_id % 5 < 3 GROUP BY ALL
""")
def _(a):
    k = F.col("peer_id") % 5
    folders = a.peers.select(F.col("peer_id").cast("string").alias("folder"), (k != 0).alias("exists"), F.when(k == 2, '{"pages": ').when(k > 2, '{"pages": 3}').alias("manifest"))
    return audit.audit(audit.Tables(export_files=folders), ("export_files",)).groupBy("code", "category", "severity").agg(F.count("*").alias("n"))


@query("r15_index_files", """
SELECT 'SEARCH_SHARD_CORRUPTED_JSON' AS code, 'search' AS category, 'error' AS severity, count(DISTINCT peer_id) AS n FROM messages WHERE message_id % 50 = 0
UNION ALL SELECT 'SEARCH_MANIFEST_MALFORMED_JSON', 'search', 'error', count(*) FROM peers WHERE peer_id % 7 = 2 UNION ALL SELECT 'SEARCH_MANIFEST_UNREADABLE', 'search', 'error', count(*) FROM peers WHERE peer_id % 7 = 1 UNION ALL SELECT 'SEARCH_MANIFEST_MISSING', 'search', 'warning', 1
""")
def _(a):
    k = F.col("peer_id") % 7
    manifests = a.peers.select(F.col("peer_id").cast("string").alias("path"), F.when(k == 2, "[1, ").when(k != 1, '{"shards": []}').alias("text"))
    shards = a.messages.select(F.col("peer_id").cast("string").alias("path"), F.when(F.col("message_id") % 50 == 0, '{"id": ').otherwise(F.to_json(F.struct("message_id"))).alias("text"))
    found = audit.audit(audit.Tables(manifest_text=manifests, shard_text=shards), ("search_manifest", "search_shards")).unionByName(audit.audit(audit.Tables(manifest_text=manifests.where("path is null")), ("search_manifest",)))
    return found.groupBy("code", "category", "severity").agg(F.count("*").alias("n"))


@query("r2_foreign_keys", """
SELECT 'message_media.media_id' AS subject, CAST(count(*) AS VARCHAR) AS detail FROM message_media WHERE media_id NOT IN (SELECT media_id FROM media_objects) HAVING count(*) > 0
UNION ALL SELECT 'messages.peer_id', CAST(count(*) AS VARCHAR) FROM messages WHERE peer_id NOT IN (SELECT peer_id FROM peers) HAVING count(*) > 0
""")
def _(a):
    broken = joins.foreign_key_violations({"message_media": (a.links, ["media_id"], a.media, ["media_id"]), "messages": (a.messages, ["peer_id"], a.peers, ["peer_id"])})
    return audit.audit(audit.Tables(violations=broken), ("foreign_keys",)).select("subject", "detail")


@query("r1_schema", """
SELECT * FROM (VALUES ('SCHEMA_VERSION_OUTDATED', 'error', '4'), ('REQUIRED_TABLE_MISSING', 'fatal', 'sync_state')) v(code, severity, subject)
UNION ALL SELECT * FROM (VALUES ('REQUIRED_COLUMN_MISSING', 'error', 'peers.phone'), ('REQUIRED_COLUMN_MISSING', 'error', 'peers.raw')) w
""")
def _(a):
    """The derived archive's own columns against a catalog that asks for more."""
    wanted = {"peers": ["peer_id", "peer_type", "name", "phone", "raw"], "messages": ["peer_id", "message_id"], "sync_state": ["pts"]}
    return audit.schema_findings(a.spark, wanted, {"peers": a.peers.columns, "messages": a.messages.columns}, 4, 5).select("code", "severity", "subject")


@query("x2_file_names", "SELECT peer_id, message_id, 'msg-u' || CAST(peer_id AS VARCHAR) || '-' || CAST(message_id AS VARCHAR) AS anchor, 'page-' || lpad(CAST(message_id % 30 + 1 AS VARCHAR), 4, '0') || '.html' AS page, 'chats/u' || CAST(peer_id AS VARCHAR) AS folder FROM messages")
def _(a):
    return a.messages.select("peer_id", "message_id", ids.message_anchor("peer_id", "message_id").alias("anchor"), ids.page_file(F.col("message_id") % 30).alias("page"), ids.peer_dir("peer_id").alias("folder"))


@query("x9_content_path", "SELECT media_id, 'media/' || substr(sha256(media_id), 1, 2) || '/' || sha256(media_id) || '.bin' AS path FROM media_objects")
def _(a):
    return a.media.select("media_id", text.content_path(F.sha2("media_id", 256), F.lit("bin")).alias("path"))


@query("x13_parse_entities", "SELECT peer_id, message_id, 0 AS entity_no, CAST(message_id % 5 AS BIGINT) AS \"offset\", CAST(length(text) AS BIGINT) AS length FROM messages WHERE text IS NOT NULL")
def _(a):
    flat = F.format_string('[{"offset": %d, "length": %d}]', F.col("message_id") % 5, F.length("text"))
    nested = F.format_string('[{"Mention": {"offset": %d, "length": %d}}]', F.col("message_id") % 5, F.length("text"))
    rows = a.messages.where("text is not null").withColumn("entities_json", F.when(F.col("message_id") % 2 == 0, flat).otherwise(nested))
    return audit.entity_bounds(rows).select("peer_id", "message_id", "entity_no", "offset", "length")


@query("x19_reply_snippet", "SELECT doc_id, CASE WHEN length(l) > 100 THEN substr(l, 1, 97) || '...' ELSE coalesce(l, 'Attachment') END AS snippet FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1] AS l FROM documents)")
def _(a):
    return a.table("documents").select("doc_id", text.reply_snippet("text", F.lit("active")).alias("snippet"))


@query("x20_is_outgoing", "SELECT peer_id, message_id, sender_id IS NULL OR sender_id = 7 AS outgoing FROM messages")
def _(a):
    return a.messages.select("peer_id", "message_id", (F.col("sender_id").isNull() | (F.col("sender_id") == 7)).alias("outgoing"))


@query("x21_service_label", "SELECT message_id, CASE message_id % 4 WHEN 0 THEN 'Ann created group \"G\"' WHEN 1 THEN 'Someone pinned a message' WHEN 2 THEN 'Ann: odd thing' ELSE 'Ann joined by link' END AS label FROM messages")
def _(a):
    k = F.col("message_id") % 4
    rows = a.messages.select("message_id", F.when(k == 0, "create_group").when(k == 1, "pin_message").when(k == 2, "odd_thing").otherwise("join_group_by_link").alias("action"), F.when(k != 1, "Ann").alias("actor"), F.lit("G").alias("title"))
    return rows.select("message_id", readers.service_label("action", "actor", "title").alias("label"))


@query("x25_export_media_kind", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'voice' WHEN 3 THEN 'photo' ELSE 'document' END AS kind FROM part")
def _(a):
    k = F.col("p_partkey") % 5
    rows = a.table("part").select("p_partkey", F.when(k == 1, "video_file").when(k == 2, "voice_message").alias("media_type"), F.when(k == 0, "p.jpg").alias("photo"), F.when(k == 3, "image/png").when(k == 4, "text/plain").alias("mime"))
    return rows.select("p_partkey", readers.export_media_kind("media_type", "photo", "mime").alias("kind"))
