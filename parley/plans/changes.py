"""Queries: merges, revisions, deletes and other change application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as m
from .registry import query

CHANGED_PEERS = "ch AS (SELECT peer_id + 50 AS peer_id, 'user' AS peer_type, CASE WHEN peer_id % 2 = 0 THEN 'new ' || CAST(peer_id AS VARCHAR) END AS name, username, updated_at + 5 AS updated_at FROM peers)"


def _peer_changes(a):
    return a.peers.select((F.col("peer_id") + 50).alias("peer_id"), F.lit("user").alias("peer_type"), F.when(F.col("peer_id") % 2 == 0, F.concat(F.lit("new "), F.col("peer_id").cast("string"))).alias("name"), "username", (F.col("updated_at") + 5).alias("updated_at"))


@query("m1_merge_peers", f"""
WITH {CHANGED_PEERS} SELECT coalesce(b.peer_id, c.peer_id) AS peer_id, CASE WHEN c.peer_id IS NULL THEN b.peer_type ELSE c.peer_type END AS peer_type, CASE WHEN c.peer_id IS NULL THEN b.name ELSE c.name END AS name,
 CASE WHEN c.peer_id IS NULL THEN b.username ELSE c.username END AS username, CASE WHEN c.peer_id IS NULL THEN b.updated_at ELSE c.updated_at END AS updated_at FROM peers b FULL JOIN ch c ON b.peer_id = c.peer_id
""")
def _(a):
    return m.merge_peers(a.peers, _peer_changes(a))


@query("m2_merge_peers_auxiliary", f"""
WITH {CHANGED_PEERS} SELECT coalesce(b.peer_id, c.peer_id) AS peer_id, coalesce(b.peer_type, c.peer_type) AS peer_type, coalesce(c.name, b.name) AS name, coalesce(c.username, b.username) AS username, coalesce(c.updated_at, b.updated_at) AS updated_at
FROM peers b FULL JOIN ch c ON b.peer_id = c.peer_id
""")
def _(a):
    return m.merge_peers(a.peers, _peer_changes(a), auxiliary=True)


def _versions(a):
    return a.feed.where("kind <> 'delete'").select("peer_id", "message_id", "date", "text", "views", F.when(F.col("kind") == "edit", "edited").otherwise("active").alias("state"), F.when(F.col("kind") == "edit", F.col("date")).alias("edit_date"), "seq")


def _stored(a):
    """What was there before: the third of all keys, with a text of its own."""
    return a.feed.groupBy("peer_id", "message_id").agg(F.min("date").alias("date")).where("(peer_id + message_id) % 3 = 0").select("peer_id", "message_id", "date", F.lit("stored").alias("text"), F.lit(0).cast("long").alias("views"), F.lit("active").alias("state"), F.lit(None).cast("long").alias("edit_date"))


LOG = """
v AS (SELECT peer_id, message_id, date, text, views, CASE kind WHEN 'edit' THEN 'edited' ELSE 'active' END AS state, CASE WHEN kind = 'edit' THEN date END AS edit_date, seq FROM feed WHERE kind <> 'delete'),
st AS (SELECT peer_id, message_id, min(date) AS date, 'stored' AS text, 0 AS views, 'active' AS state, NULL AS edit_date, -1 AS seq FROM feed GROUP BY peer_id, message_id HAVING (peer_id + message_id) % 3 = 0),
lg AS (SELECT * FROM st UNION ALL SELECT * FROM v)"""


@query("m3_merge_messages", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY peer_id, message_id ORDER BY seq DESC) AS k FROM lg) SELECT peer_id, message_id, date, text, CAST(views AS BIGINT) AS views, state, CAST(edit_date AS BIGINT) AS edit_date FROM r WHERE k = 1")
def _(a):
    return m.merge_messages(_stored(a), _versions(a))[0]


@query("m4_derive_revisions", f"""
WITH {LOG}, w AS (SELECT *, lead(seq) OVER o AS nseq, lead(text) OVER o AS ntext, lead(edit_date) OVER o AS nedit FROM lg WINDOW o AS (PARTITION BY peer_id, message_id ORDER BY seq)),
 c AS (SELECT * FROM w WHERE nseq IS NOT NULL AND (ntext IS DISTINCT FROM text OR (nedit IS NOT NULL AND nedit IS DISTINCT FROM edit_date)))
SELECT peer_id, message_id, text, CAST(edit_date AS BIGINT) AS edit_date, CAST(row_number() OVER (PARTITION BY peer_id, message_id ORDER BY seq) AS INTEGER) AS revision_no FROM c
""")
def _(a):
    return m.merge_messages(_stored(a), _versions(a))[1].select("peer_id", "message_id", "text", "edit_date", "revision_no")


@query("m5_apply_channel_deletes", """
WITH d AS (SELECT DISTINCT peer_id, message_id + (message_id % 4 = 1)::INT * 1000000000 AS message_id FROM messages WHERE message_id % 3 = 0)
SELECT coalesce(m.peer_id, d.peer_id) AS peer_id, coalesce(m.message_id, d.message_id) AS message_id, CASE WHEN d.peer_id IS NOT NULL THEN 'deleted' ELSE m.state END AS state, coalesce(m.date, 1700000000) AS date FROM messages m FULL JOIN d ON m.peer_id = d.peer_id AND m.message_id = d.message_id
""")
def _(a):
    gone = a.messages.where("message_id % 3 = 0").selectExpr("peer_id", "message_id + IF(message_id % 4 = 1, 1000000000, 0) AS message_id")
    return m.apply_channel_deletes(a.messages, gone, 1700000000).select("peer_id", "message_id", "state", "date")


COMMON = """
k AS (SELECT DISTINCT peer_id, message_id FROM feed WHERE kind <> 'delete'), d AS (SELECT DISTINCT message_id FROM feed UNION SELECT 1000 + message_id FROM feed UNION SELECT 2000),
h AS (SELECT k.message_id, count(*) AS n, min(k.peer_id) AS peer_id FROM k JOIN peers p USING (peer_id) WHERE p.peer_type IN ('user', 'group') GROUP BY k.message_id)"""


def _deletes(a):
    ids = a.feed.select("message_id").distinct()
    return ids.union(ids.select(F.col("message_id") + 1000)).union(a.spark.range(2000, 2001).toDF("message_id"))


@query("m6_classify_common_deletes", f"WITH {COMMON} SELECT d.message_id, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 1 THEN 'delete' WHEN 0 THEN 'tombstone' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN peer_id END AS peer_id FROM d LEFT JOIN h USING (message_id)")
def _(a):
    return m.classify_common_deletes(a.feed.where("kind <> 'delete'").select("peer_id", "message_id").distinct(), a.peers, _deletes(a))


@query("m7_mark_deleted", "SELECT peer_id, message_id, text, CASE WHEN message_id % 9 = 0 THEN 'deleted' ELSE state END AS state FROM messages")
def _(a):
    return m.mark_deleted(a.messages, a.messages.where("message_id % 9 = 0")).select("peer_id", "message_id", "text", "state")


@query("m8_merge_tombstones", """
WITH b AS (SELECT message_id, min(seq) AS pts, CAST(NULL AS BIGINT) AS pts_count, min(date) AS observed_at FROM feed WHERE message_id < 5 GROUP BY 1), c AS (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN max(seq) END AS pts, CAST(count(*) AS BIGINT) AS pts_count, max(date) AS observed_at FROM feed WHERE message_id > 2 GROUP BY 1)
SELECT coalesce(b.message_id, c.message_id) AS message_id, CAST(coalesce(c.pts, b.pts) AS BIGINT) AS pts, coalesce(c.pts_count, b.pts_count) AS pts_count, coalesce(b.observed_at, c.observed_at) AS observed_at FROM b FULL JOIN c ON b.message_id = c.message_id
""")
def _(a):
    base = a.feed.where("message_id < 5").groupBy("message_id").agg(F.min("seq").cast("long").alias("pts"), F.lit(None).cast("long").alias("pts_count"), F.min("date").alias("observed_at"))
    change = a.feed.where("message_id > 2").groupBy("message_id").agg(F.when(F.col("message_id") % 2 == 0, F.max("seq")).cast("long").alias("pts"), F.count("*").alias("pts_count"), F.max("date").alias("observed_at"))
    return m.merge(base, change, ["message_id"], m.TOMBSTONES)


@query("m9_merge_media", """
WITH c AS (SELECT 'doc_' || CAST(CAST(substr(media_id, 5) AS BIGINT) + 7 AS VARCHAR) AS media_id, 'document' AS kind, mime_type, size_bytes, 'pending' AS download_status, 'unverified' AS verification_status, local_rel_path, sha256 || 'x' AS sha256 FROM media_objects)
SELECT coalesce(b.media_id, c.media_id) AS media_id, coalesce(c.kind, b.kind) AS kind, coalesce(c.mime_type, b.mime_type) AS mime_type, coalesce(c.size_bytes, b.size_bytes) AS size_bytes,
 CASE WHEN c.media_id IS NULL OR b.download_status IN ('completed', 'downloading') THEN b.download_status ELSE c.download_status END AS download_status,
 CASE WHEN c.media_id IS NULL OR b.download_status = 'completed' THEN b.verification_status ELSE c.verification_status END AS verification_status,
 coalesce(b.local_rel_path, c.local_rel_path) AS local_rel_path, coalesce(b.sha256, c.sha256) AS sha256 FROM media_objects b FULL JOIN c ON b.media_id = c.media_id
""")
def _(a):
    columns = ["media_id", "kind", "mime_type", "size_bytes", "download_status", "verification_status", "local_rel_path", "sha256"]
    moved = F.concat(F.lit("doc_"), (F.substring("media_id", 5, 20).cast("long") + 7).cast("string"))
    change = a.media.select(*columns).withColumns({"media_id": moved, "kind": F.lit("document"), "download_status": F.lit("pending"), "verification_status": F.lit("unverified"), "sha256": F.concat("sha256", F.lit("x"))})
    return m.merge_media(a.media.select(*columns), change)


@query("m10_merge_message_media", """
WITH c AS (SELECT peer_id, message_id, media_id, role, position + 10 AS position FROM message_media WHERE message_id % 2 = 0 UNION ALL SELECT peer_id, message_id, media_id, 'thumb', 0 FROM message_media WHERE message_id % 5 = 0)
SELECT coalesce(b.peer_id, c.peer_id) AS peer_id, coalesce(b.message_id, c.message_id) AS message_id, coalesce(b.media_id, c.media_id) AS media_id, coalesce(b.role, c.role) AS role, coalesce(c.position, b.position) AS position
FROM message_media b FULL JOIN c ON b.peer_id = c.peer_id AND b.message_id = c.message_id AND b.media_id = c.media_id AND b.role = c.role
""")
def _(a):
    change = a.links.where("message_id % 2 = 0").withColumn("position", F.col("position") + 10).unionByName(a.links.where("message_id % 5 = 0").withColumns({"role": F.lit("thumb"), "position": F.lit(0)}))
    return m.merge(a.links, change, ["peer_id", "message_id", "media_id", "role"], m.MESSAGE_MEDIA)


STATES = """
b AS (SELECT peer_id, min(seq) AS pts, min(message_id) AS min_id, max(message_id) AS max_id FROM feed WHERE peer_id % 2 = 0 GROUP BY 1), c AS (SELECT peer_id, max(seq) AS pts, CASE WHEN peer_id % 4 = 0 THEN 0 END AS min_id, CASE WHEN peer_id % 3 = 0 THEN 99 END AS max_id FROM feed WHERE peer_id % 3 = 0 GROUP BY 1)"""


def _sync(a):
    base = a.feed.where("peer_id % 2 = 0").groupBy("peer_id").agg(F.min("seq").alias("pts"), F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"))
    change = a.feed.where("peer_id % 3 = 0").groupBy("peer_id").agg(F.max("seq").alias("pts")).withColumns({"min_id": F.when(F.col("peer_id") % 4 == 0, 0).cast("long"), "max_id": F.when(F.col("peer_id") % 3 == 0, 99).cast("long")})
    return base, change


@query("m11_merge_sync_state", f"WITH {STATES} SELECT coalesce(b.peer_id, c.peer_id) AS peer_id, CASE WHEN c.peer_id IS NULL THEN b.pts ELSE c.pts END AS pts, coalesce(c.min_id, b.min_id) AS min_id, coalesce(c.max_id, b.max_id) AS max_id FROM b FULL JOIN c ON b.peer_id = c.peer_id")
def _(a):
    return m.merge_sync_state(*_sync(a))


@query("m13_merge_backlog", """
WITH b AS (SELECT peer_id, max(seq) AS discovered_pts, CAST(NULL AS BIGINT) AS current_pts, 'completed' AS status, 3 AS attempts FROM feed WHERE peer_id % 2 = 0 GROUP BY 1), c AS (SELECT peer_id, min(seq) + 5 AS discovered_pts, min(seq) AS current_pts, 'pending' AS status, 0 AS attempts FROM feed WHERE peer_id % 3 = 0 GROUP BY 1)
SELECT coalesce(b.peer_id, c.peer_id) AS peer_id, greatest(b.discovered_pts, c.discovered_pts) AS discovered_pts, coalesce(c.current_pts, b.current_pts) AS current_pts, coalesce(c.status, b.status) AS status, coalesce(b.attempts, c.attempts) AS attempts FROM b FULL JOIN c ON b.peer_id = c.peer_id
""")
def _(a):
    base = a.feed.where("peer_id % 2 = 0").groupBy("peer_id").agg(F.max("seq").cast("long").alias("discovered_pts"), F.lit(None).cast("long").alias("current_pts"), F.lit("completed").alias("status"), F.lit(3).alias("attempts"))
    change = a.feed.where("peer_id % 3 = 0").groupBy("peer_id").agg((F.min("seq") + 5).cast("long").alias("discovered_pts"), F.min("seq").cast("long").alias("current_pts"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return m.merge_backlog(base, change)


@query("m16_migrate_legacy_media", """
WITH l AS (SELECT media_id, sha256 || CASE WHEN CAST(substr(media_id, 5) AS BIGINT) % 2 = 0 THEN '' ELSE 'z' END AS sha256, CAST(substr(media_id, 5) AS BIGINT) % 5 <> 0 AS verified FROM media_objects)
SELECT l.media_id || CASE WHEN m.verification_status = 'verified' AND l.verified AND l.sha256 <> m.sha256 THEN '_legacy_conflict' ELSE '' END AS media_id, l.sha256, l.verified FROM l JOIN media_objects m USING (media_id)
""")
def _(a):
    k = F.substring("media_id", 5, 20).cast("long")
    return m.migrate_legacy_media(a.media, a.media.select(F.col("media_id").alias("media_key"), F.when(k % 2 == 0, F.col("sha256")).otherwise(F.concat("sha256", F.lit("z"))).alias("sha256"), (k % 5 != 0).alias("verified")))


@query("m17_set_media_status", """
WITH o AS (SELECT media_id, CASE CAST(substr(media_id, 5) AS BIGINT) % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'retry' WHEN 2 THEN 'failed' ELSE 'requeue' END AS outcome, 60 AS wait FROM media_objects WHERE CAST(substr(media_id, 5) AS BIGINT) % 3 = 0)
SELECT media_id, CASE WHEN outcome = 'completed' THEN 'completed' WHEN outcome = 'failed' THEN 'permanently_failed' WHEN outcome = 'requeue' THEN 'pending' WHEN outcome = 'retry' AND retry_count + 1 >= 3 THEN 'permanently_failed' WHEN outcome = 'retry' THEN 'retry_wait' ELSE download_status END AS download_status,
 CASE WHEN outcome = 'retry' THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN outcome = 'retry' AND retry_count + 1 < 3 THEN 1700000000 + 60 * least(retry_count + 1, 5) WHEN outcome IS NULL THEN next_retry_at END AS next_retry_at FROM media_objects LEFT JOIN o USING (media_id)
""")
def _(a):
    k = F.substring("media_id", 5, 20).cast("long")
    outcome = F.when(k % 4 == 0, "completed").when(k % 4 == 1, "retry").when(k % 4 == 2, "failed").otherwise("requeue")
    return m.set_media_status(a.media, a.media.where(k % 3 == 0).select("media_id", outcome.alias("outcome"), F.lit(60).alias("wait")), 1700000000, 3).select("media_id", "download_status", "retry_count", "next_retry_at")


@query("o1_merge_dialog_lists", """
WITH l AS (SELECT peer_id, 0 AS list_no, CAST(message_id AS BIGINT) AS position FROM messages WHERE message_id % 3 = 0 UNION ALL SELECT peer_id, 1, message_id FROM messages WHERE message_id % 2 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY list_no, position) AS k FROM l)
SELECT peer_id, list_no, position FROM f WHERE k = 1 AND peer_id NOT IN (SELECT peer_id FROM peers WHERE peer_id % 6 = 0)
""")
def _(a):
    lists = a.messages.where("message_id % 3 = 0").selectExpr("peer_id", "0 AS list_no", "message_id AS position").union(a.messages.where("message_id % 2 = 0").selectExpr("peer_id", "1 AS list_no", "message_id AS position"))
    return m.merge_dialog_lists(lists, a.peers.where("peer_id % 6 = 0"))


@query("o2_stale_channels", """
WITH l AS (SELECT peer_id, max(seq) AS pts FROM feed WHERE peer_id % 4 <> 0 GROUP BY 1), s AS (SELECT peer_id, count(*) + peer_id % 3 - 1 AS pts, peer_id % 7 <> 0 AS resolved FROM feed GROUP BY 1)
SELECT s.peer_id, CAST(l.pts AS BIGINT) AS local_pts, s.pts, CASE WHEN NOT resolved THEN 'blocked' WHEN l.pts IS NULL THEN 'baseline' ELSE 'pending' END AS status FROM s LEFT JOIN l USING (peer_id) WHERE NOT resolved OR l.pts IS NULL OR s.pts > l.pts
""")
def _(a):
    local = a.feed.where("peer_id % 4 <> 0").groupBy("peer_id").agg(F.max("seq").cast("long").alias("pts"))
    server = a.feed.groupBy("peer_id").agg(F.count("*").alias("n")).selectExpr("peer_id", "n + peer_id % 3 - 1 AS pts", "peer_id % 7 <> 0 AS resolved")
    return m.stale_channels(local, server)


@query("o5_removed_days", "SELECT DISTINCT peer_id, CAST(trunc(date / 86400) AS BIGINT) AS day FROM messages EXCEPT SELECT peer_id, CAST(trunc(date / 86400) AS BIGINT) FROM messages WHERE message_id % 5 <> 0")
def _(a):
    days = a.messages.selectExpr("peer_id", "message_id", "date div 86400 AS day")
    return m.removed_keys(days, days.where("message_id % 5 <> 0"), ["peer_id", "day"])
