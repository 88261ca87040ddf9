"""Queries: full-text search over the documents, and entry search over the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, search, windows
from .registry import query

SPLIT = "list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
POSTINGS = f"t AS (SELECT doc_id, {SPLIT} AS toks FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM t), p AS (SELECT token, doc_id, dl, count(*) AS tf FROM u GROUP BY ALL)"


def _postings(a):
    return search.build_postings(a.table("documents").select("doc_id", "text"), ("doc_id",))


@query("f1_build_postings", f"WITH {POSTINGS} SELECT token, doc_id, CAST(dl AS INTEGER) AS dl, tf FROM p")
def _(a):
    return _postings(a).select("token", "doc_id", "dl", "tf")


@query("f2_refresh_postings", "WITH t AS (SELECT peer_id, message_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM messages WHERE state IN ('active', 'edited') AND text IS NOT NULL) SELECT token, peer_id, message_id, count(*) AS tf FROM t GROUP BY ALL")
def _(a):
    old = a.messages.withColumns({"text": F.when(F.col("message_id") % 3 == 0, "before edit").otherwise(F.col("text")), "state": F.when(F.col("message_id") % 5 == 0, "deleted").otherwise(F.col("state"))})
    return search.refresh_postings(search.build_postings(old), a.messages, a.messages.where("message_id % 3 = 0 or message_id % 5 = 0")).select("token", "peer_id", "message_id", "tf")


BM25_SQL = f"""
WITH {POSTINGS}, s AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM p)), h AS (SELECT * FROM p WHERE token IN ('the', 'that')), d AS (SELECT token, count(*) AS df FROM h GROUP BY token),
 r AS (SELECT doc_id, count(*) AS k, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS rank FROM h JOIN d USING (token), s GROUP BY doc_id)
SELECT doc_id, round(rank, 6) AS rank FROM r WHERE k = 2
"""


@query("f4_bm25", BM25_SQL)
def _(a):
    return search.search_texts(a.table("documents").select("doc_id", "text"), "The that", ("doc_id",)).select("doc_id", F.round("rank", 6).alias("rank"))


@query("f4_bm25_index", BM25_SQL)
def _(a):
    """The same by an inverted index."""
    return search.search(_postings(a), "The that", ("doc_id",)).select("doc_id", F.round("rank", 6).alias("rank"))


@query("f5_phrase", f"WITH t AS (SELECT doc_id, ' ' || array_to_string({SPLIT}, ' ') || ' ' AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM t WHERE contains(line, ' of the ')")
def _(a):
    return search.phrase_matches(_postings(a), "of the", ("doc_id",))


@query("f7_tokenize", "SELECT peer_id, message_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM messages WHERE text IS NOT NULL")
def _(a):
    return a.messages.where("text is not null").select("peer_id", "message_id", F.array_join(search.tokenize("text"), " ").alias("tokens"))


def _entries(a):
    """Every seventh message is forwarded, one in 41 is empty, one in 43 out of reach."""
    k = F.col("message_id")
    state = F.when(k % 41 == 0, "empty").when(k % 43 == 0, "inaccessible").otherwise(F.col("state"))
    rows = a.messages.withColumns({"state": state, "forward_json": F.when(k % 7 == 0, "{}")})
    names = joins.authoritative_names(a.peers)
    return search.search_entries(rows, search.entry_senders(rows, a.peers, names), names, search.message_kinds(a.links, a.media), windows.assign_pages(rows))


ENTRIES = """
n AS (SELECT peer_id, name, coalesce(name, '@' || username, 'Chat ' || CAST(peer_id AS VARCHAR)) AS display_name FROM peers),
k AS (SELECT peer_id, message_id, list_sort(list(DISTINCT kind)) AS kinds FROM message_media JOIN media_objects USING (media_id) GROUP BY ALL),
b AS (SELECT * REPLACE (CASE WHEN message_id % 41 = 0 THEN 'empty' WHEN message_id % 43 = 0 THEN 'inaccessible' ELSE state END AS state), CAST(floor((row_number() OVER (PARTITION BY peer_id ORDER BY message_id) - 1) / 250) AS INTEGER) AS page_no FROM messages),
e AS (SELECT b.peer_id, b.message_id, b.date, coalesce(b.text, '') AS text, b.state, CASE WHEN b.sender_id IS NULL THEN c.display_name ELSE coalesce(s.name, 'User ' || CAST(b.sender_id AS VARCHAR)) END AS sender_name, c.display_name AS chat_name,
  b.reply_to_msg_id IS NOT NULL AS is_reply, b.message_id % 7 = 0 AS is_fwd, coalesce(kinds, []) AS kinds, 'chats/u' || CAST(b.peer_id AS VARCHAR) || '/page-' || lpad(CAST(page_no + 1 AS VARCHAR), 4, '0') || '.html#msg-u' || CAST(b.peer_id AS VARCHAR) || '-' || CAST(b.message_id AS VARCHAR) AS url
  FROM b LEFT JOIN n s ON s.peer_id = b.sender_id LEFT JOIN n c ON c.peer_id = b.peer_id LEFT JOIN k ON k.peer_id = b.peer_id AND k.message_id = b.message_id WHERE b.state NOT IN ('empty', 'inaccessible')),
x AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(text || ' ' || coalesce(sender_name, '') || ' ' || coalesce(chat_name, '')), '[^a-z0-9]+'), lambda w: w <> ''))) AS toks, CAST(floor((row_number() OVER (ORDER BY peer_id, message_id) - 1) / 250) AS INTEGER) AS shard_id FROM e)"""


@query("f8_search_entries", f"WITH {ENTRIES} SELECT peer_id, message_id, state, text, sender_name, chat_name, is_reply, is_fwd, array_to_string(kinds, ' ') AS kinds, url, array_to_string(toks, ' ') AS tokens FROM x")
def _(a):
    return _entries(a).select("peer_id", "message_id", "state", "text", "sender_name", "chat_name", "is_reply", "is_fwd", F.array_join("media_kinds", " ").alias("kinds"), "url", F.array_join("tokens", " ").alias("tokens"))


@query("f9_prefix_index", f"WITH {ENTRIES}, w AS (SELECT shard_id, unnest(toks) AS t FROM x) SELECT DISTINCT substr(t, 1, k) AS prefix, shard_id FROM w, (SELECT unnest([1, 2, 3]) AS k)")
def _(a):
    return search.prefix_index(windows.entry_shards(_entries(a), 250))


@query("f10_candidate_shards", f"""
WITH {ENTRIES}, w AS (SELECT shard_id, unnest(toks) AS t FROM x), s AS (SELECT shard_id, count(*) AS n_entries, count(DISTINCT peer_id) AS n_peers, min(date) AS min_date, max(date) AS max_date FROM x GROUP BY 1)
SELECT * FROM s WHERE shard_id IN (SELECT shard_id FROM w GROUP BY 1 HAVING bool_or(starts_with(t, 'urg')) AND bool_or(starts_with(t, '12'))) AND max_date >= 820454400
 AND shard_id IN (SELECT shard_id FROM x WHERE peer_id = 100)
""")
def _(a):
    from ..operators.aggregates import shard_stats

    entries = windows.entry_shards(_entries(a), 250)
    return search.candidate_shards(search.prefix_index(entries), shard_stats(entries), "urgent 12", start=820454400, peer=100).drop("peer_ids")


SCORED = f"""{ENTRIES}, z AS (SELECT *, len(list_filter(toks, lambda w: w = 'urgent')) + len(list_filter(toks, lambda w: w = 'note')) AS exact FROM x WHERE len(list_filter(toks, lambda w: starts_with(w, 'urgent'))) > 0 AND len(list_filter(toks, lambda w: starts_with(w, 'note'))) > 0),
 sc AS (SELECT *, CAST(CASE WHEN contains(lower(text), 'urgent note') THEN 100 WHEN exact = 2 THEN 50 ELSE 20 + 5 * exact END AS INTEGER) AS score FROM z)"""


@query("f11_score_entries", f"WITH {SCORED} SELECT peer_id, message_id, score FROM sc")
def _(a):
    return search.score_entries(_entries(a), "urgent note").select("peer_id", "message_id", "score")


@query("f12_faceted_search", f"WITH {SCORED} SELECT peer_id, message_id, score FROM sc WHERE state = 'edited' AND date >= 820454400 ORDER BY score DESC, date DESC, peer_id, message_id LIMIT 50")
def _(a):
    return search.faceted_search(_entries(a), "urgent note", state="edited", start=820454400).select("peer_id", "message_id", "score")


@query("f12_facets", f"""
WITH {ENTRIES}, z AS (SELECT *, toks FROM x WHERE len(list_filter(toks, lambda w: starts_with(w, 'urgent'))) > 0), f AS (
 SELECT 'media' AS facet, peer_id, message_id, CAST(CASE WHEN contains(lower(text), 'urgent') THEN 100 ELSE 50 END AS INTEGER) AS score FROM z WHERE list_contains(kinds, 'video')
 UNION ALL SELECT 'deleted', peer_id, message_id, CASE WHEN contains(lower(text), 'urgent') THEN 100 ELSE 50 END FROM z WHERE state = 'deleted'
 UNION ALL SELECT 'forwarded', peer_id, message_id, 1 FROM x WHERE is_fwd AND is_reply AND date <= 820454400)
SELECT * FROM f
""")
def _(a):
    """All hits of three facets. A query of signs alone finds nothing."""
    entries, whole = _entries(a), 1 << 30
    found = {
        "media": search.faceted_search(entries, "urgent", whole, media="video"), "deleted": search.faceted_search(entries, "urgent", whole, state="deleted"),
        "forwarded": search.faceted_search(entries, " ", whole, is_fwd=True, is_reply=True, end=820454400), "signs": search.faceted_search(entries, "!?", whole),
    }
    rows = [part.select(F.lit(facet).alias("facet"), "peer_id", "message_id", "score") for facet, part in found.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("t1_top_matches", f"WITH {SCORED} SELECT peer_id, message_id, score FROM sc ORDER BY score DESC, date DESC, peer_id, message_id LIMIT 50")
def _(a):
    return search.top_matches(search.score_entries(_entries(a), "urgent note")).select("peer_id", "message_id", "score")


@query("f13_highlight", "SELECT peer_id, message_id, replace(text, 'note', '<mark>note</mark>') AS shown FROM messages WHERE text IS NOT NULL")
def _(a):
    return a.messages.where("text is not null").select("peer_id", "message_id", search.highlight("text", "note").alias("shown"))


@query("o4_intersect_candidates", f"WITH {ENTRIES}, w AS (SELECT shard_id, unnest(toks) AS t FROM x) SELECT shard_id FROM w WHERE t IN ('urgent', 'high') GROUP BY 1 HAVING count(DISTINCT t) = 2")
def _(a):
    tokens = windows.entry_shards(_entries(a), 250).select("shard_id", F.explode("tokens").alias("t")).where("t in ('urgent', 'high')")
    return tokens.groupBy("shard_id").agg(F.countDistinct("t").alias("n")).where("n = 2").select("shard_id")
