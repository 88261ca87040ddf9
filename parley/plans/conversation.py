"""Queries: pages, albums, clusters and the reply graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import graph
from ..operators import windows as win
from .registry import query

PAGES = "p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY peer_id ORDER BY message_id) - 1) / 5) AS INTEGER) AS page_no, CAST(trunc(date / 86400) AS BIGINT) AS day FROM messages)"


@query("w1_assign_pages", "SELECT peer_id, message_id, CAST(floor((row_number() OVER (PARTITION BY peer_id ORDER BY message_id) - 1) / 5) AS INTEGER) AS page_no FROM messages")
def _(a):
    return win.assign_pages(a.messages, 5).select("peer_id", "message_id", "page_no")


@query("w2_assign_day_pages", """
SELECT peer_id, message_id, CAST(dense_rank() OVER (PARTITION BY peer_id ORDER BY CAST(trunc(date / 86400) AS BIGINT)) AS INTEGER) AS day_no,
 'day-' || strftime(make_timestamp(date * 1000000), '%Y-%m-%d') || '.html' AS day_file FROM messages
""")
def _(a):
    return win.assign_day_pages(a.messages).select("peer_id", "message_id", "day_no", "day_file")


@query("w3_date_index", f"WITH {PAGES} SELECT peer_id, day, min(message_id) AS message_id, arg_min(page_no, message_id) AS page_no FROM p GROUP BY peer_id, day")
def _(a):
    return win.date_index(win.assign_pages(a.messages, 5))


@query("w4_group_albums", """
WITH f AS (SELECT *, CASE WHEN grouped_id IS NULL OR grouped_id IS DISTINCT FROM lag(grouped_id) OVER (PARTITION BY peer_id ORDER BY message_id) THEN 1 ELSE 0 END AS fresh FROM messages),
 i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY peer_id ORDER BY message_id) AS BIGINT) AS item_no FROM f)
SELECT peer_id, message_id, item_no, count(*) OVER (PARTITION BY peer_id, item_no) AS item_size, grouped_id IS NOT NULL AND count(*) OVER (PARTITION BY peer_id, item_no) > 1 AS is_album FROM i
""")
def _(a):
    return win.group_albums(a.messages).select("peer_id", "message_id", "item_no", "item_size", "is_album")


@query("w5_album_continuation", """
WITH p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY peer_id ORDER BY message_id) - 1) / 3) AS INTEGER) AS page_no FROM messages),
 w AS (SELECT peer_id, message_id, page_no, coalesce(lag(grouped_id) OVER o = grouped_id AND lag(page_no) OVER o <> page_no, false) AS continued, coalesce(lead(grouped_id) OVER o = grouped_id AND lead(page_no) OVER o <> page_no, false) AS continues
  FROM p WINDOW o AS (PARTITION BY peer_id ORDER BY message_id))
SELECT * FROM w WHERE continued OR continues
""")
def _(a):
    return win.album_continuation(win.assign_pages(a.messages, 3))


CLUSTER = """
c AS (SELECT peer_id, message_id, page_no, sender_id, is_service,
 lag(message_id) OVER o IS NULL OR lag(is_service) OVER o OR is_service OR lag(sender_id) OVER o IS DISTINCT FROM sender_id OR lag(is_outgoing) OVER o IS DISTINCT FROM is_outgoing OR abs(lag(date) OVER o - date) > 100000000 AS first_of_cluster,
 lead(message_id) OVER o IS NULL OR lead(is_service) OVER o OR is_service OR lead(sender_id) OVER o IS DISTINCT FROM sender_id OR lead(is_outgoing) OVER o IS DISTINCT FROM is_outgoing OR abs(lead(date) OVER o - date) > 100000000 AS last_of_cluster
 FROM p WINDOW o AS (PARTITION BY peer_id, page_no ORDER BY message_id))"""


def _clustered(a):
    rows = a.messages.withColumns({"sender_id": F.when(F.col("message_id") % 4 != 0, F.col("message_id") % 2), "is_outgoing": F.col("message_id") % 32 < 8})
    pages = win.assign_pages(rows, 5)
    return win.sender_clusters(pages, gap=100_000_000)


TWO = "m2 AS (SELECT * REPLACE (CASE WHEN message_id % 4 <> 0 THEN message_id % 2 END AS sender_id), message_id % 32 < 8 AS is_outgoing FROM messages), " + PAGES.replace("FROM messages", "FROM m2")


@query("w6_sender_clusters", f"WITH {TWO}, {CLUSTER} SELECT * FROM c")
def _(a):
    return _clustered(a)


@query("w7_show_sender", f"""
WITH {TWO}, {CLUSTER},
 s AS (SELECT c.*, peer_type, max(CASE WHEN NOT is_service THEN message_id END) OVER (PARTITION BY c.peer_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c JOIN peers USING (peer_id))
SELECT s.peer_id, s.message_id, CASE peer_type WHEN 'user' THEN NOT s.is_service AND (before IS NULL OR l.sender_id IS DISTINCT FROM s.sender_id) WHEN 'group' THEN first_of_cluster AND s.sender_id IS NOT NULL AND NOT s.is_service ELSE false END AS show_sender
FROM s LEFT JOIN m2 l ON l.peer_id = s.peer_id AND l.message_id = s.before
""")
def _(a):
    return win.show_sender(_clustered(a), a.peers)


@query("w8_date_separators", f"""
WITH {PAGES}, s AS (SELECT *, lag(day) OVER (PARTITION BY peer_id, page_no ORDER BY message_id) AS before FROM p)
SELECT peer_id, message_id, page_no, day, row_number() OVER (PARTITION BY peer_id, page_no, day ORDER BY message_id) = 1 AS has_anchor FROM s WHERE before IS NULL OR before <> day
""")
def _(a):
    return win.date_separators(win.assign_pages(a.messages, 5))


@query("w9_revision_order_check", """
WITH r AS (SELECT peer_id, message_id, seq AS revision_no, date - views * 100000 AS edit_date FROM feed WHERE kind = 'edit'),
 w AS (SELECT *, lag(edit_date) OVER (PARTITION BY peer_id, message_id ORDER BY revision_no) AS previous FROM r)
SELECT peer_id, message_id, revision_no, previous, edit_date FROM w WHERE previous > edit_date
""")
def _(a):
    return win.revision_order_check(a.feed.where("kind = 'edit'").selectExpr("peer_id", "message_id", "seq AS revision_no", "date - views * 100000 AS edit_date"))


@query("w10_entry_shards", "SELECT peer_id, message_id, CAST(floor((row_number() OVER (ORDER BY peer_id, message_id) - 1) / 250) AS INTEGER) AS shard_id FROM messages")
def _(a):
    return win.entry_shards(a.messages.select("peer_id", "message_id"), 250)


@query("a16_shard_stats", """
WITH s AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY peer_id, message_id) - 1) / 250) AS INTEGER) AS shard_id FROM messages)
SELECT shard_id, count(*) AS n_entries, count(DISTINCT peer_id) AS n_peers, string_agg(DISTINCT CAST(peer_id AS VARCHAR), ',' ORDER BY CAST(peer_id AS VARCHAR)) AS peers, min(date) AS min_date, max(date) AS max_date FROM s GROUP BY shard_id
""")
def _(a):
    found = agg.shard_stats(win.entry_shards(a.messages.select("peer_id", "message_id", "date"), 250))
    return found.select("shard_id", "n_entries", "n_peers", F.array_join(F.array_sort(F.col("peer_ids").cast("array<string>")), ",").alias("peers"), "min_date", "max_date")


@query("w11_prev_next_pages", f"WITH {PAGES} SELECT peer_id, page_no, lag(page_no) OVER o AS prev_page, lead(page_no) OVER o AS next_page FROM (SELECT DISTINCT peer_id, page_no FROM p) WINDOW o AS (PARTITION BY peer_id ORDER BY page_no)")
def _(a):
    return win.prev_next_pages(win.assign_pages(a.messages, 5))


@query("g1_replies_to", """
SELECT coalesce(m.reply_to_peer_id, m.peer_id) AS target_peer_id, m.reply_to_msg_id AS target_message_id, count(*) AS n_replies, min(m.message_id) AS first_reply_id FROM messages m WHERE m.reply_to_msg_id IS NOT NULL GROUP BY ALL
""")
def _(a):
    return graph.replies_to(a.messages)


@query("g2_self_replies", "SELECT peer_id, message_id FROM messages WHERE reply_to_msg_id = message_id AND coalesce(reply_to_peer_id, peer_id) = peer_id")
def _(a):
    return graph.self_replies(a.messages)


EDGES = """
e AS (SELECT m.peer_id AS sp, m.message_id AS sm, t.peer_id AS tp, t.message_id AS tm FROM messages m JOIN messages t ON t.peer_id = coalesce(m.reply_to_peer_id, m.peer_id) AND t.message_id = m.reply_to_msg_id
  WHERE NOT (t.peer_id = m.peer_id AND t.message_id = m.message_id)),
walk AS (SELECT peer_id AS p0, message_id AS m0, peer_id AS p, message_id AS m, 0 AS depth FROM messages
  UNION ALL SELECT p0, m0, tp, tm, depth + 1 FROM walk JOIN e ON e.sp = walk.p AND e.sm = walk.m WHERE depth < 64)"""


@query("g5_reply_depth", f"""
WITH RECURSIVE {EDGES}, x AS (SELECT p0, m0, max(depth) AS d, arg_max(p, depth) AS p, arg_max(m, depth) AS m FROM walk GROUP BY p0, m0)
SELECT p0 AS peer_id, m0 AS message_id, CASE WHEN d < 64 THEN CAST(d AS BIGINT) END AS depth, CASE WHEN d < 64 THEN p END AS root_peer_id, CASE WHEN d < 64 THEN m END AS root_message_id FROM x
""")
def _(a):
    return graph.reply_depth(graph.walks(a.messages, 64), 64)


@query("g3_reply_cycles", f"""
WITH RECURSIVE {EDGES}, x AS (SELECT p0, m0, max(depth) AS d FROM walk GROUP BY p0, m0), c AS (SELECT w.p0, w.m0, min(w.p * 1000000000 + w.m) AS least FROM walk w WHERE EXISTS (SELECT 1 FROM walk v WHERE v.p0 = w.p0 AND v.m0 = w.m0 AND v.depth > 0 AND v.p = v.p0 AND v.m = v.m0) GROUP BY w.p0, w.m0),
 tails AS (SELECT w.p0, w.m0, min(c.least) AS least FROM walk w JOIN c ON c.p0 = w.p AND c.m0 = w.m GROUP BY w.p0, w.m0)
SELECT t.least // 1000000000 AS peer_id, t.least % 1000000000 AS message_id, count(c.p0) AS n_members, count(*) - count(c.p0) AS tail_count FROM tails t LEFT JOIN c USING (p0, m0) GROUP BY t.least
""")
def _(a):
    return graph.reply_cycles(graph.walks(a.messages, 64), a.messages, 64)


@query("g4_deep_chains", f"""
WITH RECURSIVE {EDGES}, x AS (SELECT p0, m0, max(depth) AS d FROM walk GROUP BY p0, m0) SELECT p0 AS peer_id, m0 AS message_id, CAST(d AS BIGINT) AS depth FROM x WHERE d >= 2 AND d < 64
""")
def _(a):
    return graph.deep_chains(graph.walks(a.messages, 64), 2, 64)


TOPICS = "CASE WHEN message_id % 5 = 0 THEN message_id % 3 + 2 END"


def _topical(a):
    return a.messages.withColumn("reply_to_top_id", F.expr(f"CAST({TOPICS} AS BIGINT)"))


def _topic_events(a):
    return a.messages.where("message_id % 11 = 0").selectExpr("peer_id", "message_id", "CAST(message_id % 4 + 2 AS BIGINT) AS topic_id", "CASE WHEN message_id % 2 = 0 THEN concat('T', CAST(message_id AS STRING)) END AS title", "CASE WHEN message_id % 3 = 0 THEN true END AS closed", "CASE WHEN message_id % 7 = 0 THEN true END AS pinned")


TOPIC_SQL = f"""
ev AS (SELECT peer_id, message_id, message_id % 4 + 2 AS topic_id, CASE WHEN message_id % 2 = 0 THEN 'T' || CAST(message_id AS VARCHAR) END AS title, CASE WHEN message_id % 3 = 0 THEN true END AS closed, CASE WHEN message_id % 7 = 0 THEN true END AS pinned FROM messages WHERE message_id % 11 = 0),
told AS (SELECT peer_id, topic_id, arg_max(title, message_id) FILTER (WHERE title IS NOT NULL) AS title, arg_max(closed, message_id) FILTER (WHERE closed IS NOT NULL) AS closed, arg_max(pinned, message_id) FILTER (WHERE pinned IS NOT NULL) AS pinned FROM ev GROUP BY peer_id, topic_id),
ids AS (SELECT peer_id, {TOPICS} AS topic_id FROM messages WHERE {TOPICS} IS NOT NULL UNION SELECT peer_id, 1 FROM messages UNION SELECT peer_id, topic_id FROM told),
topics AS (SELECT ids.peer_id, CAST(ids.topic_id AS BIGINT) AS topic_id, coalesce(title, CASE WHEN ids.topic_id = 1 THEN 'General' ELSE 'Topic ' || CAST(ids.topic_id AS VARCHAR) END) AS title, coalesce(closed, false) AS closed, coalesce(pinned, false) AS pinned FROM ids LEFT JOIN told USING (peer_id, topic_id))"""


@query("g6_discover_topics", f"WITH {TOPIC_SQL} SELECT * FROM topics")
def _(a):
    return graph.discover_topics(_topical(a), _topic_events(a))


MESSAGE_TOPIC = f"""
mt AS (SELECT m.peer_id, m.message_id, m.date, CAST(CASE WHEN m.message_id % 19 = 0 THEN m.message_id WHEN {TOPICS} IS NOT NULL THEN {TOPICS} WHEN m.reply_to_msg_id % 19 = 0 AND r.message_id IS NOT NULL THEN m.reply_to_msg_id ELSE 1 END AS BIGINT) AS topic_id
 FROM messages m LEFT JOIN messages r ON r.peer_id = m.peer_id AND r.message_id = m.reply_to_msg_id AND r.message_id % 19 = 0)""".replace("message_id % 5", "m.message_id % 5").replace("message_id % 3", "m.message_id % 3")


@query("g7_message_topic", f"WITH {MESSAGE_TOPIC} SELECT peer_id, message_id, topic_id FROM mt")
def _(a):
    return graph.message_topic(_topical(a), a.messages.where("message_id % 19 = 0").selectExpr("peer_id", "message_id AS topic_id"))


@query("a8_topic_summary", f"""
WITH {TOPIC_SQL}, mt AS (SELECT peer_id, coalesce({TOPICS}, 1) AS topic_id, date FROM messages),
 s AS (SELECT peer_id, topic_id, count(*) AS n_messages, max(date) AS last_date FROM mt GROUP BY ALL)
SELECT t.*, coalesce(n_messages, 0) AS n_messages, last_date FROM topics t LEFT JOIN s USING (peer_id, topic_id)
""")
def _(a):
    rows = _topical(a)
    return agg.topic_summary(rows.select("peer_id", F.coalesce("reply_to_top_id", F.lit(1)).cast("long").alias("topic_id"), "date"), graph.discover_topics(rows, _topic_events(a)))


@query("g8_relation_kind", f"""
SELECT m.peer_id, m.message_id, CASE WHEN m.reply_to_peer_id <> m.peer_id AND p.peer_type = 'channel' THEN 'channel_discussion' WHEN m.reply_to_peer_id <> m.peer_id THEN 'cross_chat'
 WHEN m.message_id % 5 = 0 AND p.peer_type = 'group' THEN 'forum_topic' WHEN m.message_id % 5 = 0 THEN 'comment_thread' ELSE 'direct_reply' END AS relation
FROM messages m LEFT JOIN peers p USING (peer_id) WHERE m.reply_to_msg_id IS NOT NULL
""")
def _(a):
    return graph.relation_kind(_topical(a), a.peers)
