"""Queries: change feeds, activity, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, reactions, text
from ..operators import merge as m
from ..streaming import feed as fd
from .registry import query


@query("c3_dedupe_updates", "SELECT kind, count(DISTINCT (peer_id, message_id, seq)) AS n FROM feed GROUP BY kind")
def _(a):
    twice = a.feed.unionByName(a.feed.where("event_id % 2 = 0"))
    return fd.dedupe_updates(twice).groupBy("kind").agg(F.count("*").alias("n"))


def _updates(a, *more):
    """The feed in slices of ten; one event in 97 is of an unknown kind. more: columns of the feed beside those of updates."""
    odd = F.col("event_id") % 97 == 5
    return a.feed.select(
        F.when(odd, "unsupported").otherwise(F.col("kind")).alias("kind"), F.floor(F.col("seq") / 10).alias("slice_id"), F.col("seq").cast("long").alias("seq"), "peer_id", F.when(~odd, F.col("message_id")).alias("message_id"), "date", "text",
        F.when(F.col("kind") == "edit", "edited").otherwise("active").alias("state"), F.when(F.col("kind") == "edit", F.col("date")).alias("edit_date"), "views", F.col("seq").cast("long").alias("pts"), F.lit(1).cast("long").alias("pts_count"), (F.col("event_id") % 2 == 0).alias("affects_state"),
        F.struct("peer_id", F.lit("user").alias("peer_type"), F.concat(F.lit("p"), F.col("seq").cast("string")).alias("name"), F.lit(None).cast("string").alias("username"), F.col("date").alias("updated_at")).alias("peer"), *more,
    )


UPDATES_SQL = """
up AS (SELECT *, event_id % 97 = 5 AS odd, event_id % 2 = 0 AS affects, seq // 10 AS slice_id FROM feed),
bl AS (SELECT peer_id, min(slice_id) AS stop FROM up WHERE odd AND affects GROUP BY peer_id),
rd AS (SELECT up.* FROM up LEFT JOIN bl USING (peer_id) WHERE (stop IS NULL OR slice_id < stop) AND NOT odd)"""


@query("c4_freeze_on_unsupported", f"WITH {UPDATES_SQL} SELECT peer_id, count(*) AS n, CAST(max(seq) AS BIGINT) AS pts FROM rd GROUP BY peer_id")
def _(a):
    return fd.freeze_on_unsupported(_updates(a))[0].groupBy("peer_id").agg(F.count("*").alias("n"), F.max("pts").alias("pts"))


def _applied(a):
    tables = {
        "messages": fd.empty_table(a.spark, "messages").select("peer_id", "message_id", "date", "text", "state", "edit_date", F.col("views").cast("long").alias("views")),
        "peers": a.peers, "sync_state": fd.empty_table(a.spark, "sync_state"),
    }
    return fd.apply_update_slice(tables, _updates(a))


@query("m18_apply_update_slice", f"""
WITH {UPDATES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY peer_id, message_id ORDER BY seq DESC) AS k FROM rd WHERE kind IN ('new', 'edit')),
 l AS (SELECT peer_id, message_id, arg_max(kind, seq) AS last FROM rd GROUP BY 1, 2)
SELECT v.peer_id, v.message_id, v.date, v.text, v.views, CASE WHEN last = 'delete' THEN 'deleted' WHEN v.kind = 'edit' THEN 'edited' ELSE 'active' END AS state FROM v JOIN l USING (peer_id, message_id) WHERE k = 1
""")
def _(a):
    return _applied(a)["messages"].select("peer_id", "message_id", "date", "text", "views", "state")


@query("m12_merge_account_state", f"WITH {UPDATES_SQL}, s AS (SELECT peer_id, max(seq) AS pts FROM rd GROUP BY 1) SELECT peer_id, CAST(pts AS INTEGER) AS pts, stop IS NOT NULL AS uncertain FROM s FULL JOIN bl USING (peer_id)")
def _(a):
    return _applied(a)["sync_state"].select("peer_id", "pts", "uncertain")


@query("m19_dead_letter", f"WITH {UPDATES_SQL} SELECT peer_id, count(*) AS n, count(*) FILTER (WHERE affects) AS n_affecting FROM up WHERE odd GROUP BY peer_id")
def _(a):
    return _applied(a)["unsupported_events"].groupBy("peer_id").agg(F.count("*").alias("n"), F.count_if("affects_state").alias("n_affecting"))


@query("c5_snapshot_reconcile", "SELECT m.peer_id, count(*) AS n FROM messages m LEFT JOIN (SELECT peer_id, max(message_id) AS top FROM messages WHERE message_id % 5 = 0 GROUP BY 1) t USING (peer_id) WHERE top IS NULL OR message_id > top GROUP BY 1")
def _(a):
    return fd.snapshot_reconcile(a.messages.where("message_id % 5 = 0"), a.messages).groupBy("peer_id").agg(F.count("*").alias("n"))


@query("c6_history_backfill", "SELECT peer_id, count(*) AS n FROM messages WHERE message_id % 4 <> 1 AND date >= 820454400 GROUP BY 1")
def _(a):
    return fd.history_backfill(a.messages.where("message_id % 4 = 1"), a.messages, start=820454400).groupBy("peer_id").agg(F.count("*").alias("n"))


@query("c6_history_progress", "WITH p AS (SELECT peer_id, seq AS page_no, 1000 - seq * 10 + (views % 13 = 0)::INT * 100 AS min_id FROM feed) SELECT * FROM (SELECT *, lag(min_id) OVER (PARTITION BY peer_id ORDER BY page_no) AS before FROM p) WHERE min_id >= before")
def _(a):
    return fd.history_progress(a.feed.selectExpr("peer_id", "seq AS page_no", "CAST(1000 - seq * 10 + IF(views % 13 = 0, 100, 0) AS INT) AS min_id"))


@query("c8_integrity_row", f"WITH {UPDATES_SQL} SELECT 'r1' AS report_id, (SELECT count(*) FROM bl) = 0 AS lossless, false AS complete FROM (SELECT 1)")
def _(a):
    after = _applied(a)
    backlog = a.peers.where("peer_type = 'channel'").select("peer_id", F.lit("pending").alias("status"))
    return fd.integrity_row(after["messages"], after["sync_state"], backlog, False, "r1", 1700000000).select("report_id", "lossless", "complete")


@query("c9_activity_windows", "SELECT user_id AS peer_id, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def _(a):
    rows = a.table("events").select(F.col("user_id").alias("peer_id"), F.col("ts").cast("timestamp").alias("time"))
    return fd.activity_windows(rows, "time").select("peer_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("c9_activity_sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS fresh FROM events),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS peer_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k
""")
def _(a):
    rows = a.table("events").select(F.col("user_id").alias("peer_id"), F.col("ts").cast("timestamp").alias("time"))
    return fd.activity_sessions(rows, "time", "3600 seconds").select("peer_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("c10_pts_gaps", "WITH f AS (SELECT peer_id, seq AS pts, 1 AS pts_count FROM feed WHERE event_id % 5 <> 0), l AS (SELECT *, lag(pts) OVER (PARTITION BY peer_id ORDER BY pts) AS before FROM f) SELECT peer_id, before, pts, pts_count FROM l WHERE pts - pts_count > before")
def _(a):
    return fd.pts_gaps(a.feed.where("event_id % 5 <> 0").selectExpr("peer_id", "seq AS pts", "1 AS pts_count"))


@query("m20_import_to_archive", "SELECT peer_id, count(*) AS n, count(*) FILTER (WHERE state = 'edited') AS n_edited, min(sender_id) AS sender FROM messages GROUP BY peer_id")
def _(a):
    got = m.merge_messages(fd.empty_table(a.spark, "messages").select("peer_id", "message_id", "date", "text", "state", "sender_id"), a.messages.select("peer_id", "message_id", "date", "text", "state", "sender_id").withColumn("seq", F.lit(0).cast("long")))[0]
    return got.groupBy("peer_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "edited").alias("n_edited"), F.min("sender_id").alias("sender"))


@query("x1_peer_ids", "SELECT peer_id, peer_type AS kind, CASE peer_type WHEN 'channel' THEN -1000000000000 - peer_id WHEN 'group' THEN -peer_id ELSE peer_id END AS encoded, peer_id AS decoded, CASE peer_type WHEN 'channel' THEN 'c' WHEN 'group' THEN 'g' ELSE 'u' END || CAST(peer_id AS VARCHAR) AS token FROM peers")
def _(a):
    rows = a.peers.withColumn("encoded", ids.encode_peer("peer_type", "peer_id"))
    return rows.select("peer_id", ids.peer_kind("encoded").alias("kind"), "encoded", ids.decode_peer("encoded").alias("decoded"), ids.peer_token("encoded").alias("token"))


@query("x4_dates", "SELECT message_id, strftime(make_timestamp(date * 1000000), '%Y-%m-%d') AS ymd, strftime(make_timestamp(date * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS utc, date // 86400 * 86400 + 86399 AS day_end FROM messages")
def _(a):
    return a.messages.select("message_id", ids.ymd("date").alias("ymd"), ids.format_utc("date").alias("utc"), ids.date_bound(ids.ymd("date"), True).alias("day_end"))


@query("x7_slug", "SELECT doc_id, CASE WHEN s = '' THEN 'chat' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64), '_+$', '') AS s FROM documents)")
def _(a):
    return a.table("documents").select("doc_id", text.slug("text").alias("slug"))


@query("x11_synthetic_ids", "SELECT peer_id, -2000000000000000 - CAST(CAST(('0x' || substr(sha256(CAST(peer_id AS VARCHAR)), 1, 16)) AS UBIGINT) % 1000000000000000 AS BIGINT) AS chat_id FROM peers")
def _(a):
    return a.peers.select("peer_id", ids.synthetic_chat_id(F.col("peer_id").cast("string")).alias("chat_id"))


@query("x12_parse_reactions", "SELECT message_id % 4 AS k, count(*) AS n, CASE message_id % 4 WHEN 0 THEN '👍' WHEN 1 THEN 'custom:7' WHEN 2 THEN 'paid' ELSE 'unknown' END AS reaction, CAST(sum(CASE message_id % 4 WHEN 1 THEN 1 ELSE 3 END) AS BIGINT) AS total FROM messages GROUP BY 1")
def _(a):
    k = F.col("message_id") % 4
    said = F.when(k == 0, '{"results": [{"reaction": {"emoji": "👍"}, "count": 3}]}').when(k == 1, '[{"reaction": {"custom_emoji_id": "7"}}]').when(k == 2, '{"MessageReactions": {"results": [{"reaction": "Paid", "count": 3}]}}').otherwise('[{"reaction": {"x": 1}, "count": 3}]')
    got = reactions.parse_reactions(a.messages.withColumn("reactions_json", F.lit(said) if isinstance(said, str) else said))
    return got.groupBy((F.col("message_id") % 4).alias("k"), "reaction").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("x15_utf16_length", "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS n FROM documents")
def _(a):
    return a.table("documents").select("doc_id", text.utf16_length("text").alias("n"))


@query("x15_utf16_slice", "SELECT doc_id, substr(text, 4, 10) AS part FROM documents WHERE len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) = 0")
def _(a):
    """Texts without characters of two units, in which places are those of SQL."""
    rows = a.table("documents").where(text.utf16_length("text") == F.length("text"))
    return rows.select("doc_id", text.utf16_slice("text", F.lit(3), F.lit(10)).alias("part"))


@query("x16_html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped, true AS back FROM pages")
def _(a):
    rows = a.table("pages").select("page_id", "html", text.html_escape("html").alias("e"))
    return rows.select("page_id", F.md5("e").alias("escaped"), (text.html_unescape("e") == F.replace(F.col("html"), F.lit("&nbsp;"), F.lit("&nbsp;"))).alias("back"))


@query("x17_format_size", "SELECT media_id, CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B' WHEN size_bytes < 1048576 THEN format('{:.1f} KB', size_bytes / 1024.0) ELSE format('{:.1f} MB', size_bytes / 1048576.0) END AS shown FROM media_objects WHERE size_bytes IS NOT NULL")
def _(a):
    return a.media.where("size_bytes is not null").select("media_id", text.format_size("size_bytes").alias("shown"))


@query("x3_relative_path", "SELECT peer_id, '../c' || CAST(peer_id + 1 AS VARCHAR) || '/page-0001.html' AS link FROM peers")
def _(a):
    page = lambda n: F.concat(F.lit("chats/c"), n.cast("string"), F.lit("/"), ids.page_file(F.lit(0)))
    return a.peers.select("peer_id", text.relative_path(page(F.col("peer_id")), page(F.col("peer_id") + 1)).alias("link"))


@query("x8_chat_directories", "SELECT peer_id, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '_' || CAST(peer_id AS VARCHAR) ELSE s END AS directory FROM (SELECT peer_id, CASE WHEN peer_id % 17 = 0 THEN 'chat' ELSE 'dup_' || CAST(peer_id // 2 AS VARCHAR) END AS s FROM peers)")
def _(a):
    from pyspark.sql import Window

    rows = a.peers.select("peer_id", F.coalesce(text.slug(F.when(F.col("peer_id") % 17 != 0, F.concat(F.lit("Dup "), F.floor(F.col("peer_id") / 2).cast("string")))), F.lit("chat")).alias("s"))
    return rows.select("peer_id", F.when(F.count("*").over(Window.partitionBy("s")) > 1, F.concat("s", F.lit("_"), F.col("peer_id").cast("string"))).otherwise(F.col("s")).alias("directory"))
