"""Queries: audits, reports, links, fingerprints and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, fingerprints, graph, joins, links, media
from ..operators import windows as win
from ..operators.windows import numbered
from .registry import query

NOW = 1700010000


def _revisions(a):
    return a.feed.where("kind = 'edit'").selectExpr("peer_id", "message_id", "seq AS revision_no", "date - views * 100000 AS edit_date", "date")


def _files(a):
    k = F.col("p_partkey").cast("string")
    return a.table("part").where("p_partkey % 4 <> 0").select(F.concat(F.lit("media/"), k, F.lit(".bin")).alias("rel_path"), F.lit(10240).cast("long").alias("length"), F.when(F.col("p_partkey") % 13 != 0, F.concat(F.lit("h"), (F.col("p_partkey") % 250).cast("string"))).alias("sha256"), (F.col("p_partkey") % 2 == 0).alias("is_part"))


def _tables(a):
    return audit.Tables(messages=a.messages, peers=a.peers, media=a.media, links=a.links, files=_files(a), now=NOW)


def _codes(findings):
    return findings.groupBy("code", "category", "severity").agg(F.count("*").alias("n"))


FILES_SQL = "fl AS (SELECT 'media/' || CAST(p_partkey AS VARCHAR) || '.bin' AS rel_path, 10240 AS length, CASE WHEN p_partkey % 13 <> 0 THEN 'h' || CAST(p_partkey % 250 AS VARCHAR) END AS sha256, p_partkey % 2 = 0 AS is_part FROM part WHERE p_partkey % 4 <> 0)"
MATCH_SQL = FILES_SQL + """, mt AS (SELECT m.media_id, m.download_status, f.rel_path, CASE WHEN m.media_id IS NULL THEN CASE WHEN f.is_part THEN 'orphan_part' ELSE 'orphan_file' END WHEN f.rel_path IS NULL THEN 'missing' WHEN m.size_bytes <> f.length THEN 'size_mismatch' WHEN m.verification_status <> 'verified' THEN 'unverified' WHEN f.sha256 IS NULL THEN 'unreadable' WHEN m.sha256 <> f.sha256 THEN 'hash_mismatch' ELSE 'match' END AS result
 FROM (SELECT * FROM media_objects WHERE download_status = 'completed' AND local_rel_path IS NOT NULL) m FULL JOIN fl f ON f.rel_path = m.local_rel_path)"""


def _sql_rules(*parts):
    """code, category, severity and a counting query each."""
    return " UNION ALL ".join(f"SELECT '{code}' AS code, '{category}' AS category, '{severity}' AS severity, count(*) AS n FROM ({rows}) HAVING count(*) > 0" for code, category, severity, rows in parts)


R2 = [
    ("MESSAGE_WITHOUT_PEER_RECORD", "referential_integrity", "error", "SELECT DISTINCT peer_id FROM messages WHERE peer_id NOT IN (SELECT peer_id FROM peers)"),
    ("MESSAGE_MEDIA_ORPHAN_OBJECT", "referential_integrity", "error", "SELECT * FROM message_media WHERE media_id NOT IN (SELECT media_id FROM media_objects)"),
]
R3 = [("MESSAGE_ID_INVALID_RANGE", "identity", "error", "SELECT * FROM messages WHERE message_id <= 0 OR message_id > 2147483647"), ("UNKNOWN_PEER_TYPE", "identity", "warning", "SELECT * FROM peers WHERE peer_type NOT IN ('user', 'group', 'channel')")]
R4 = [
    ("MESSAGE_DATE_IMPOSSIBLE", "chronology", "error", "SELECT * FROM messages WHERE date < 1375315200 OR date > 2524608000"),
    ("CHRONOLOGY_SEVERE_INVERSION", "chronology", "warning", "SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY peer_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM messages WHERE peer_id IN (SELECT peer_id FROM peers WHERE peer_type <> 'user')) WHERE d > date + 86400"),
]
R5 = [("MESSAGE_STATE_INVALID", "message_state", "error", "SELECT * FROM messages WHERE state NOT IN ('active', 'edited', 'deleted', 'empty', 'inaccessible')")]
R11 = [
    ("MEDIA_UNVERIFIED", "media", "warning", "SELECT * FROM media_objects WHERE download_status = 'completed' AND verification_status = 'unverified'"),
    ("MEDIA_VERIFICATION_FAILED", "media", "error", "SELECT * FROM media_objects WHERE download_status = 'completed' AND verification_status NOT IN ('unverified', 'verified')"),
    ("COMPLETED_MEDIA_WITHOUT_PATH", "media", "error", "SELECT * FROM media_objects WHERE download_status = 'completed' AND local_rel_path IS NULL"),
    ("MEDIA_STALE_CLAIM", "media", "warning", f"SELECT * FROM media_objects WHERE download_status = 'downloading' AND claimed_at < {NOW - 3600}"),
    ("MEDIA_INVALID_CLAIM_STATE", "media", "warning", "SELECT * FROM media_objects WHERE (download_status = 'downloading') <> (claimed_at IS NOT NULL)"),
    ("MEDIA_RETRY_WAIT_INVALID", "media", "warning", "SELECT * FROM media_objects WHERE download_status = 'retry_wait' AND next_retry_at IS NULL"),
]
R12 = [(code, category, severity, f"SELECT * FROM mt WHERE result = '{r}'") for r, code, category, severity in (("missing", "MEDIA_FILE_MISSING", "media", "error"), ("size_mismatch", "MEDIA_SIZE_MISMATCH", "media", "error"), ("unreadable", "MEDIA_READ_FAILED", "media", "error"), ("hash_mismatch", "MEDIA_HASH_MISMATCH", "media", "error"), ("orphan_part", "ORPHAN_PART_FILE", "filesystem", "warning"), ("orphan_file", "ORPHAN_MEDIA_FILE", "media", "info"))]
REPLIES_SQL = "rp AS (SELECT m.peer_id, m.message_id, t.state, p.peer_id IS NOT NULL AS known, m.reply_to_msg_id = m.message_id AND coalesce(m.reply_to_peer_id, m.peer_id) = m.peer_id AS self FROM messages m LEFT JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id LEFT JOIN peers p ON p.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) WHERE m.reply_to_msg_id IS NOT NULL)"
R14 = [
    ("REPLY_SELF_REFERENCE", "reply_graph", "error", "SELECT * FROM rp WHERE self"), ("REPLY_TARGET_UNAVAILABLE", "reply_graph", "info", "SELECT * FROM rp WHERE NOT self AND state = 'deleted'"),
    ("REPLY_TARGET_MISSING", "reply_graph", "warning", "SELECT * FROM rp WHERE NOT self AND state IS NULL AND known"), ("REPLY_TARGET_OUT_OF_SCOPE", "reply_graph", "warning", "SELECT * FROM rp WHERE NOT self AND state IS NULL AND NOT known"),
]
EVERY = f"WITH {MATCH_SQL}, {REPLIES_SQL}, codes AS ({_sql_rules(*R2, *R3, *R4, *R5, *R11, *R12, *R14)})"


@query("r2_references", _sql_rules(*R2))
def _(a):
    return _codes(audit.audit(_tables(a), ("references", "media_references")))


@query("r3_identity", _sql_rules(*R3))
def _(a):
    return _codes(audit.audit(audit.Tables(messages=a.messages, peers=a.peers.withColumn("peer_type", F.col("peer_type"))), ("identity",)))


@query("r4_chronology", _sql_rules(*R4))
def _(a):
    return _codes(audit.audit(_tables(a), ("chronology",)))


@query("r5_state", _sql_rules(("MESSAGE_STATE_INVALID", "message_state", "error", "SELECT * FROM messages WHERE message_id % 17 = 0"), ("MESSAGE_EMPTY_CONFLATION", "message_state", "info", "SELECT * FROM messages WHERE message_id % 17 <> 0 AND message_id % 19 = 0 AND text IS NOT NULL")))
def _(a):
    rows = a.messages.withColumn("state", F.when(F.col("message_id") % 17 == 0, "broken").when(F.col("message_id") % 19 == 0, "empty").otherwise(F.col("state")))
    return _codes(audit.audit(audit.Tables(messages=rows), ("state",)))


@query("r6_revisions", _sql_rules(("REVISION_ORDER_INVALID", "revision", "error", "SELECT * FROM (SELECT peer_id, message_id, date - views * 100000 AS d, lag(date - views * 100000) OVER (PARTITION BY peer_id, message_id ORDER BY seq) AS b FROM feed WHERE kind = 'edit') WHERE b > d")))
def _(a):
    return _codes(audit.audit(audit.Tables(revisions=_revisions(a)), ("revisions",)))


def _with_entities(a):
    k = F.col("message_id") % 6
    said = (
        F.when(k == 0, F.lit('[{"Mention": {"offset": 0, "length": 4}}]')).when(k == 1, F.lit('[{"offset": 0, "length": 400}]')).when(k == 2, F.lit('[{"offset": -1, "length": 4}, {"type": "bold"}]'))
        .when(k == 3, F.lit('{"offset": 0}')).when(k == 4, F.lit("[broken"))
    )
    return a.messages.where("text is not null").withColumn("entities_json", said)


@query("r7_entities", _sql_rules(*((code, "entity", "error", f"SELECT * FROM messages WHERE text IS NOT NULL AND message_id % 6 = {k}") for code, k in (("ENTITY_UTF16_OUT_OF_BOUNDS", 1), ("ENTITY_NEGATIVE_BOUNDS", 2), ("ENTITY_MISSING_BOUNDS", 2), ("ENTITIES_NOT_ARRAY", 3), ("ENTITIES_JSON_MALFORMED", 4)))))
def _(a):
    return _codes(audit.audit(audit.Tables(messages=_with_entities(a)), ("entities",)))


@query("r8_payload", _sql_rules(("TL_MALFORMED_BYTES", "service_message", "error", "SELECT * FROM messages WHERE message_id % 10 = 3")))
def _(a):
    raw = F.when(F.col("message_id") % 10 == 3, F.unhex(F.lit("0102"))).otherwise(F.unhex(F.lit("0102030405")))
    return _codes(audit.audit(audit.Tables(messages=a.messages.withColumn("raw", raw)), ("payload",)))


@query("r9_sync_state", _sql_rules(("PEER_SYNC_UNCERTAIN", "sync_state", "warning", "SELECT DISTINCT peer_id FROM feed WHERE peer_id % 3 = 0"), ("SYNC_STATE_NEGATIVE_SEQUENCE", "sync_state", "error", "SELECT DISTINCT peer_id FROM feed WHERE peer_id % 5 = 0")))
def _(a):
    rows = a.feed.select("peer_id").distinct().select("peer_id", F.when(F.col("peer_id") % 5 == 0, -1).otherwise(1).alias("pts"), (F.col("peer_id") % 3 == 0).alias("uncertain"))
    return _codes(audit.audit(audit.Tables(sync_state=rows), ("sync_state",)))


@query("r10_events_backlog", _sql_rules(
    ("UNSUPPORTED_STATE_AFFECTING_UPDATE", "unsupported_update", "warning", "SELECT * FROM feed WHERE views = 7"), ("UNSUPPORTED_UPDATE_RECORDED", "unsupported_update", "info", "SELECT * FROM feed WHERE views = 8"),
    ("QUEUE_CHANNEL_BLOCKED", "queue", "warning", "SELECT * FROM peers WHERE peer_type = 'channel' AND peer_id % 5 = 0"), ("QUEUE_CHANNEL_PENDING", "queue", "info", "SELECT * FROM peers WHERE peer_type = 'channel' AND peer_id % 5 <> 0")))
def _(a):
    events = a.feed.where("views in (7, 8)").select("peer_id", "event_id", (F.col("views") == 7).alias("affects_state"))
    backlog = a.peers.where("peer_type = 'channel'").select("peer_id", F.when(F.col("peer_id") % 5 == 0, "blocked").otherwise("pending").alias("status"))
    return _codes(audit.audit(audit.Tables(events=events, backlog=backlog), ("events", "backlog")))


@query("r11_media_rows", _sql_rules(*R11))
def _(a):
    return _codes(audit.audit(_tables(a), ("media",)))


@query("r12_media_files", f"WITH {MATCH_SQL} {_sql_rules(*R12)}")
def _(a):
    return _codes(audit.audit(_tables(a), ("media_files",)))


@query("r13_paths", "SELECT code, 'filesystem' AS category, 'error' AS severity, count(*) AS n FROM (SELECT CASE CAST(substr(media_id, 5) AS BIGINT) % 5 WHEN 0 THEN 'PATH_ABSOLUTE_ESCAPE' WHEN 1 THEN 'PATH_WINDOWS_DRIVE_ESCAPE' WHEN 2 THEN 'PATH_TRAVERSAL_ESCAPE' WHEN 3 THEN 'PATH_TRAVERSAL_ESCAPE' END AS code FROM media_objects) WHERE code IS NOT NULL GROUP BY code")
def _(a):
    k = F.substring("media_id", 5, 20).cast("long") % 5
    path = F.when(k == 0, "/etc/x").when(k == 1, "C:\\x").when(k == 2, "media/../../x").when(k == 3, "media\\..\\x").otherwise("media/..x/y")
    return _codes(audit.audit(audit.Tables(media=a.media.withColumn("local_rel_path", path)), ("paths",)))


@query("r14_replies", f"WITH {REPLIES_SQL} {_sql_rules(*R14)}")
def _(a):
    return _codes(audit.audit(_tables(a), ("replies",)))


@query("r14_reply_walks")
def _(a):
    return _codes(audit.reply_walk_findings(a.messages, 2, 64))


def _index(a):
    entries = win.entry_shards(a.messages.select("peer_id", "message_id"), 250)
    manifest = entries.where("shard_id % 7 <> 3").groupBy("shard_id").agg((F.count("*") + F.when(F.col("shard_id") % 5 == 0, 1).otherwise(0)).alias("n_entries"))
    return audit.Tables(manifest=manifest, shards=entries.where("shard_id % 11 <> 1").select("shard_id"), prefixes=entries.select(F.lit("a").alias("prefix"), "shard_id"))


SHARDS_SQL = "sh AS (SELECT CAST(floor((row_number() OVER (ORDER BY peer_id, message_id) - 1) / 250) AS INTEGER) AS shard_id FROM messages), ss AS (SELECT DISTINCT shard_id FROM sh)"


@query("r15_search_index", f"WITH {SHARDS_SQL} " + _sql_rules(
    ("SEARCH_SHARD_MISSING", "search", "error", "SELECT * FROM ss WHERE shard_id % 7 <> 3 AND shard_id % 11 = 1"), ("SEARCH_UNDECLARED_SHARD", "search", "warning", "SELECT * FROM ss WHERE shard_id % 7 = 3 AND shard_id % 11 <> 1"),
    ("SEARCH_SHARD_ENTRIES_MISMATCH", "search", "error", "SELECT * FROM ss WHERE shard_id % 7 <> 3 AND shard_id % 11 <> 1 AND shard_id % 5 = 0"), ("SEARCH_PREFIX_INDEX_OUT_OF_BOUNDS", "search", "error", "SELECT * FROM ss WHERE shard_id % 7 = 3")))
def _(a):
    return _codes(audit.audit(_index(a), ("search_index",)))


@query("o3_union_findings", f"{EVERY} SELECT * FROM codes")
def _(a):
    return _codes(audit.audit(_tables(a)))


@query("t4_sort_findings", f"""
WITH f AS (SELECT * FROM (SELECT 'fatal' AS severity, 'schema' AS category, 'REQUIRED_TABLE_MISSING' AS code, NULL::BIGINT AS peer_id, NULL::BIGINT AS message_id, 'edges' AS subject) UNION ALL
 SELECT 'warning', 'identity', 'UNKNOWN_PEER_TYPE', peer_id, NULL, 'peer_type' FROM peers WHERE peer_type = 'channel' UNION ALL
 SELECT 'error', 'reply_graph', 'REPLY_SELF_REFERENCE', peer_id, message_id, NULL FROM messages WHERE reply_to_msg_id = message_id AND coalesce(reply_to_peer_id, peer_id) = peer_id UNION ALL
 SELECT 'error', 'message_state', 'MESSAGE_STATE_INVALID', peer_id, message_id, 'odd' FROM messages WHERE message_id % 17 = 0)
SELECT row_number() OVER (ORDER BY list_position(['fatal', 'error', 'warning', 'info'], severity), list_position({list(audit.CATEGORIES)}, category), peer_id NULLS FIRST, message_id NULLS FIRST, subject NULLS FIRST, code) AS place, severity, category, code, peer_id, message_id FROM f
""")
def _(a):
    """Places are numbered as the rows come, in ranges of the sort: the order itself is compared."""
    odd = a.messages.where("message_id % 17 = 0").withColumn("state", F.lit("odd"))
    found = audit.audit(audit.Tables(messages=odd), ("state",)).unionByName(audit.finding(graph.self_replies(a.messages), "REPLY_SELF_REFERENCE", "peer_id", "message_id"))
    found = found.unionByName(audit.finding(a.peers.where("peer_type = 'channel'"), "UNKNOWN_PEER_TYPE", "peer_id", subject=F.lit("peer_type")))
    found = found.unionByName(audit.schema_findings(a.spark, {"edges": []}, {}, 5, 5))
    return numbered(audit.sort_findings(found), "place").select("place", "severity", "category", "code", "peer_id", "message_id")


@query("a12_finding_counts", f"{EVERY}, c AS (SELECT unnest({list(audit.CATEGORIES)}) AS category), s AS (SELECT unnest({list(audit.SEVERITIES)}) AS severity) SELECT c.category, s.severity, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM c CROSS JOIN s LEFT JOIN codes USING (category, severity) GROUP BY ALL")
def _(a):
    return audit.finding_counts(audit.audit(_tables(a)))


@query("a11_media_audit_metrics", f"WITH {MATCH_SQL} SELECT result, count(*) AS n FROM mt GROUP BY result")
def _(a):
    return joins.match_files(_files(a), a.media).groupBy("result").agg(F.count("*").alias("n"))


@query("h10_overall_status", f"{EVERY}, c AS (SELECT coalesce(sum(n) FILTER (WHERE severity = 'error'), 0) AS e, coalesce(sum(n) FILTER (WHERE severity = 'warning'), 0) AS w FROM codes) SELECT CASE WHEN e > 0 THEN 'errors' WHEN w > 0 THEN 'warnings' ELSE 'passed' END AS status, CASE WHEN e > 0 THEN 2 WHEN w > 0 THEN 1 ELSE 0 END AS exit_code FROM c")
def _(a):
    return audit.overall_status(audit.audit(_tables(a)))


@query("h10_exit_code", """
WITH c AS (SELECT count(*) AS w FROM messages WHERE reply_to_msg_id IS NULL AND state = 'edited')
SELECT CASE WHEN w > 0 THEN 'warnings' ELSE 'passed' END AS status, CASE WHEN w = 0 THEN 0 WHEN strict THEN 2 ELSE 1 END AS exit_code, strict FROM c, (VALUES (false), (true)) s(strict)
""")
def _(a):
    """Warnings alone, strict and not."""
    warned = audit.finding(a.messages.where("reply_to_msg_id is null and state = 'edited'"), "EDITED_WITHOUT_REVISION_HISTORY", "peer_id", "message_id")
    return audit.overall_status(warned).withColumn("strict", F.lit(False)).union(audit.overall_status(warned, True).withColumn("strict", F.lit(True)))


ACTIONS_SQL = "ac AS (SELECT * FROM (VALUES " + ", ".join(f"('{code}', '{action}', '{kind}', '{risk}')" for action, (kind, risk, codes) in audit.ACTIONS.items() for code in codes) + ") v(code, action, kind, risk))"


@query("h11_repair_plan", f"{EVERY}, {ACTIONS_SQL} SELECT action, kind, risk, CAST(sum(n) AS BIGINT) AS n_affected, string_agg(code, ',' ORDER BY code) AS codes FROM codes JOIN ac USING (code) GROUP BY action, kind, risk")
def _(a):
    return audit.repair_plan(audit.audit(_tables(a))).withColumn("codes", F.array_join("codes", ","))


@query("h9_completeness", f"""
WITH {MATCH_SQL}, n AS (SELECT (SELECT count(*) FROM media_objects) AS total, count(*) FILTER (WHERE result = 'match') AS good, count(*) FILTER (WHERE result IN ('missing', 'size_mismatch', 'hash_mismatch')) AS bad FROM mt),
 u AS (SELECT count(*) AS k FROM media_objects WHERE download_status = 'completed' AND verification_status <> 'verified')
SELECT * FROM (VALUES ('message_history', 'incomplete', 1::BIGINT, 'MESSAGE_WITHOUT_PEER_RECORD'), ('deletion_verification', 'incomplete', 1, 'DELETION_RECONCILIATION_INCOMPLETE'), ('channel_discovery', 'complete', 0, ''), ('sync_uncertainty', 'clean', 0, ''), ('html_export', 'not_applicable', 0, ''), ('search_index', 'not_applicable', 0, '')) v(dimension, status, n_affected, evidence)
UNION ALL SELECT 'media_binaries', CAST(round(100.0 * good / total, 1) AS DECIMAL(10, 1)) || '%', bad + k, 'MEDIA_FILE_MISSING' FROM n, u
""")
def _(a):
    report = a.feed.agg(F.lit(2).alias("provenance_version"), F.lit(True).alias("deletions_performed"), F.lit(True).alias("deletions_complete"), F.count("*").alias("deletion_gaps"), F.lit(True).alias("channels_complete"))
    found = audit.completeness(audit.audit(_tables(a)), report, audit.media_metrics(a.media, joins.match_files(_files(a), a.media)))
    return found.select("dimension", "status", "n_affected", F.array_join("evidence", ",").alias("evidence"))


def _pages(a):
    """Pages by their URL's path, without the host."""
    return a.table("pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "").alias("page"), "html")


@query("l1_extract_links", "SELECT page_id AS page, h AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, ' href=\"([^\"]*)\"', 1)) AS h FROM pages) WHERE h <> '#' GROUP BY ALL")
def _(a):
    return links.extract_links(a.table("pages"), "page_id").groupBy(F.col("page_id").alias("page"), "href").agg(F.count("*").alias("n"))


def _marked(a):
    """Pages with an anchor after each paragraph's start, so that anchors exist."""
    html = F.concat(F.lit('<i id="top"></i><i id="top"></i><img src="media/'), F.col("page_id").cast("string"), F.lit('.png"><i id="msg-'), (F.col("page_id") % 20).cast("string"), F.lit('"></i>'))
    return a.table("pages").select("page_id", html.alias("html"))


@query("l2_duplicate_anchors", "SELECT 'top' AS anchor, CAST(page_id AS VARCHAR) AS page, 2 AS n, 'page' AS scope FROM pages UNION ALL SELECT 'msg-' || CAST(page_id % 20 AS VARCHAR), NULL, count(*), 'export' FROM pages GROUP BY page_id % 20 HAVING count(*) > 1")
def _(a):
    return links.duplicate_anchors(links.extract_anchors(_marked(a), "page_id"), "page_id")


@query("l1_extract_media_refs", "SELECT page_id, 'media/' || CAST(page_id AS VARCHAR) || '.png' AS src FROM pages")
def _(a):
    return links.extract_media_refs(_marked(a), "page_id")


LINKS_SQL = """
h AS (SELECT page_id, unnest(regexp_extract_all(html, ' href="([^"]*)"', 1)) AS href FROM pages),
f AS (SELECT page_id, href FROM h WHERE href <> '#' AND NOT regexp_matches(lower(href), '^(http:|https:|mailto:|tel:|tg:|ftp:|data:|javascript:|//)'))"""


@query("l3_broken_links", f"""
WITH {LINKS_SQL}, p AS (SELECT CAST(page_id AS VARCHAR) AS page FROM pages)
SELECT page_id, CASE WHEN starts_with(href, '#') THEN 'missing_anchor' ELSE 'missing_page' END AS reason, count(*) AS n FROM f WHERE ltrim(href, '/') NOT IN (SELECT page FROM p) GROUP BY ALL
""")
def _(a):
    pages = a.table("pages").select("page_id", "html")
    found = links.broken_links(links.extract_links(pages, "page_id"), pages, links.extract_anchors(pages, "page_id"), "page_id")
    return found.groupBy("page_id", "reason").agg(F.count("*").alias("n"))


@query("l3_reasons", f"""
WITH {LINKS_SQL} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'missing_page' WHEN 1 THEN 'missing_anchor' WHEN 2 THEN 'escapes_root' ELSE 'bad_characters' END AS reason, count(*) AS n FROM f WHERE page_id % 5 <> 4 GROUP BY ALL
""")
def _(a):
    """The pages' links, made to anchors, ways out of the root, bad characters or existing pages by their page."""
    pages = a.table("pages").select("page_id", "html")
    k, word = F.col("page_id") % 5, F.replace(F.col("href"), F.lit("/"), F.lit(""))
    made = F.when(k == 0, F.concat(F.lit("none/"), word)).when(k == 1, F.concat(F.lit("#"), word)).when(k == 2, F.concat(F.lit("x/../../"), word)).when(k == 3, F.concat(F.lit("a\\b"), word)).otherwise(F.concat(F.lit("./"), F.col("page_id").cast("string")))
    internal = F.col("href").startswith("/") & ~F.col("href").startswith("//")
    rows = links.extract_links(pages, "page_id").where(internal).withColumn("href", made)
    found = links.broken_links(rows, pages, links.extract_anchors(pages, "page_id"), "page_id")
    return found.groupBy("page_id", "reason").agg(F.count("*").alias("n"))


@query("l4_bundle_counts", "SELECT peer_id, n + 1 AS n_pages, n AS found FROM (SELECT peer_id, CAST(ceil(count(*) / 5.0) AS BIGINT) AS n FROM messages GROUP BY peer_id) WHERE peer_id % 3 = 0")
def _(a):
    pages = win.assign_pages(a.messages, 5).select("peer_id", "page_no").distinct()
    manifest = pages.groupBy("peer_id").agg((F.count("*") + F.when(F.col("peer_id") % 3 == 0, 1).otherwise(0)).alias("n_pages"))
    return links.bundle_counts(pages, manifest)


def _edited(a):
    return a.messages.withColumn("text", F.when(F.col("message_id") % 50 == 0, "other").otherwise(F.col("text")))


@query("h2_chat_fingerprint", "SELECT peer_id, count(*) AS n_messages FROM messages GROUP BY peer_id")
def _(a):
    return fingerprints.chat_fingerprint(a.messages, a.links, fingerprints.config_fingerprint({"theme": "plain"})).where("length(fingerprint) = 64").select("peer_id", "n_messages")


@query("h5_changed_chats", "SELECT DISTINCT peer_id, 'changed' AS change FROM messages WHERE message_id % 50 = 0")
def _(a):
    return fingerprints.changed_keys(fingerprints.chat_fingerprint(a.messages), fingerprints.chat_fingerprint(_edited(a)), ["peer_id"])


@query("h3_changed_days", "SELECT DISTINCT peer_id, CAST(trunc(date / 86400) AS BIGINT) AS day, 'changed' AS change FROM messages WHERE message_id % 50 = 0")
def _(a):
    return fingerprints.changed_keys(fingerprints.day_fingerprint(a.messages), fingerprints.day_fingerprint(_edited(a)), ["peer_id", "day"])


@query("h1_dataset_fingerprint", "SELECT count(DISTINCT peer_id) AS n_chats, count(*) AS n_messages, true AS same FROM messages")
def _(a):
    """The digest doesn't depend on how the rows are partitioned."""
    one = fingerprints.dataset_fingerprint(a.messages, a.links)
    two = fingerprints.dataset_fingerprint(a.messages.repartition(7, "date"), a.links).select(F.col("fingerprint").alias("other"))
    return one.crossJoin(two).select("n_chats", "n_messages", (F.col("fingerprint") == F.col("other")).alias("same"))


@query("h6_page_rows", "SELECT peer_id, page_no, count(*) AS n_rows, string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY message_id) AS ids FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY peer_id ORDER BY message_id) - 1) / 5) AS INTEGER) AS page_no FROM messages) GROUP BY peer_id, page_no")
def _(a):
    return fingerprints.page_rows(win.assign_pages(a.messages, 5)).select("peer_id", "page_no", "n_rows", F.array_join(F.transform("rows", lambda r: r["message_id"].cast("string")), ",").alias("ids"))


@query("h7_dialog_index", "SELECT p.peer_id, p.peer_type, coalesce(p.name, '@' || p.username, 'Chat ' || CAST(p.peer_id AS VARCHAR)) AS display_name, m.n_messages, m.last_date FROM peers p JOIN (SELECT peer_id, count(*) AS n_messages, max(date) AS last_date FROM messages GROUP BY 1) m USING (peer_id)")
def _(a):
    return fingerprints.dialog_index(a.peers, a.messages, joins.authoritative_names(a.peers))


@query("h8_message_history", "SELECT peer_id, message_id, 'v' || CAST(row_number() OVER (PARTITION BY peer_id, message_id ORDER BY seq) AS VARCHAR) AS version, date - views * 100000 AS shown_at FROM feed WHERE kind = 'edit'")
def _(a):
    return fingerprints.message_history(_revisions(a)).select("peer_id", "message_id", "version", "shown_at")


POLICY = {"kinds": ["photo", "video", "document"], "most_bytes": 40960, "blocked_mimes": ["application/x-mpegURL"]}
POLICY_SQL = "pl AS (SELECT *, CASE WHEN kind NOT IN ('photo', 'video', 'document') THEN 'kind' WHEN size_bytes > 40960 THEN 'size' WHEN mime_type = 'application/x-mpegURL' THEN 'mime' END AS reason FROM media_objects)"


@query("d1_apply_policy", f"WITH {POLICY_SQL} SELECT media_id, CASE WHEN download_status = 'skipped' AND reason IS NULL THEN 'pending' WHEN download_status = 'pending' AND reason IS NOT NULL THEN 'skipped' ELSE download_status END AS download_status, reason AS filter_reason FROM pl")
def _(a):
    return media.apply_policy(a.media, POLICY, 2).select("media_id", "download_status", "filter_reason")


@query("x23_media_policy", f"WITH {POLICY_SQL} SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM pl GROUP BY 1")
def _(a):
    return a.media.groupBy(F.coalesce(media.media_policy(POLICY)[1], F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("x24_media_availability", "SELECT media_id, reason IS NULL AS available, reason FROM (SELECT media_id, CASE WHEN download_status = 'skipped' THEN 'skipped' WHEN download_status = 'permanently_failed' THEN 'failed' WHEN download_status <> 'completed' THEN 'not_downloaded' WHEN verification_status = 'missing_file' THEN 'missing' WHEN verification_status LIKE 'corrupted%' THEN 'corrupted' END AS reason FROM media_objects)")
def _(a):
    return media.media_availability(a.media)


@query("d2_reconcile_media", f"""
WITH {FILES_SQL}, r AS (SELECT m.media_id, m.download_status AS s, CASE WHEN m.local_rel_path IS NULL OR f.rel_path IS NULL THEN 'missing' WHEN m.size_bytes <> f.length THEN 'size_mismatch' WHEN m.verification_status <> 'verified' THEN 'unverified' WHEN f.sha256 IS NULL THEN 'unreadable' WHEN m.sha256 <> f.sha256 THEN 'hash_mismatch' ELSE 'match' END AS result FROM media_objects m LEFT JOIN fl f ON f.rel_path = m.local_rel_path WHERE m.download_status IN ('downloading', 'completed'))
SELECT media_id, CASE WHEN result = 'match' THEN 'completed' WHEN s = 'downloading' OR result = 'missing' THEN 'pending' ELSE 'completed' END AS download_status, CASE result WHEN 'match' THEN 'verified' WHEN 'size_mismatch' THEN 'corrupted_size' WHEN 'hash_mismatch' THEN 'corrupted_hash' ELSE 'missing_file' END AS verification_status FROM r
""")
def _(a):
    return media.reconcile_media(a.media, _files(a))


@query("d3_verify_media", f"WITH {MATCH_SQL} SELECT media_id, CASE result WHEN 'match' THEN 'verified' WHEN 'size_mismatch' THEN 'size' WHEN 'hash_mismatch' THEN 'hash' ELSE 'missing' END AS outcome FROM mt WHERE media_id IS NOT NULL")
def _(a):
    return media.verify_media(a.media, _files(a))


@query("d4_dedupe_media", "SELECT media_id, min(media_id) OVER (PARTITION BY sha256) AS kept_id FROM media_objects WHERE download_status = 'completed'")
def _(a):
    return media.dedupe_media(a.media)


@query("d5_chunk_plan", "SELECT media_id, CAST(k AS INTEGER) AS chunk_no, k * 10240 AS \"offset\", least(10240, CAST(ceil((size_bytes - k * 10240) / 1024.0) * 1024 AS BIGINT)) AS \"limit\" FROM media_objects, (SELECT unnest(range(100)) AS k) WHERE k * 10240 < size_bytes")
def _(a):
    return media.chunk_plan(a.media, 10240)


@query("d6_plan_media", "SELECT media_id, CASE WHEN kind IN ('photo', 'video', 'document') AND coalesce(size_bytes, 0) <= 40960 AND coalesce(mime_type, '') <> 'application/x-mpegURL' THEN 'pending' ELSE 'skipped' END AS download_status FROM media_objects WHERE media_id IN (SELECT media_id FROM message_media)")
def _(a):
    rows = a.links.join(a.media, "media_id").groupBy("peer_id", "message_id").agg(F.sort_array(F.collect_list(F.struct("media_id", "kind", "mime_type", "size_bytes", "role"))).alias("media"))
    return media.plan_media(rows, POLICY)[0].select("media_id", "download_status")


@query("d7_copy_manifest", f"WITH {FILES_SQL} SELECT DISTINCT l.peer_id, f.rel_path, f.length FROM message_media l JOIN media_objects m USING (media_id) JOIN fl f ON f.rel_path = m.local_rel_path")
def _(a):
    return media.copy_manifest(a.links, a.media, _files(a))


@query("x27_retry_next", "SELECT media_id, CASE WHEN CAST(substr(media_id, 5) AS BIGINT) % 2 = 1 OR retry_count + 1 >= 3 THEN 'permanently_failed' ELSE 'retry_wait' END AS download_status, CASE WHEN CAST(substr(media_id, 5) AS BIGINT) % 2 = 0 AND retry_count + 1 < 3 THEN 1700010000 + 30 * least(retry_count + 1, 5) END AS next_retry_at FROM media_objects")
def _(a):
    kind = F.when(F.substring("media_id", 5, 20).cast("long") % 2 == 1, "forbidden").otherwise("timeout")
    return media.retry_next(a.media.select("media_id", kind.alias("error_class"), "retry_count", F.lit(30).alias("wait")), NOW, 3)
