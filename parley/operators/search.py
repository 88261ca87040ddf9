"""Full-text search: an inverted index with BM25, and an entry index with shards and prefixes.

Two tokenizers on purpose: the inverted index drops diacritics, the entry index keeps them.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import message_anchor, page_file, peer_dir

K1, B = 1.2, 0.75


#: Texts that are Python strings at a time: a batch has thousands, which take several times their bytes.
FOLDED_ROWS = 32


#: Combining marks of 16 bits; a class with longer ones as well would be searched range by range.
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c)) + "]+")
_LONG = re.compile("[\U00010000-\U0010ffff]")


def folded(text: str) -> str:
    """The text in lower case, decomposed, without combining marks."""
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))
    return _LONG.sub(lambda c: "" if unicodedata.combining(c[0]) else c[0], text)


def fold_texts(texts: pa.Array) -> pa.Array:
    parts = (texts[at : at + FOLDED_ROWS].to_pylist() for at in range(0, len(texts), FOLDED_ROWS))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else folded(t) for t in part], pa.string()) for part in parts)])


@F.arrow_udf(T.StringType())
def _fold(text: pa.Array) -> pa.Array:
    return fold_texts(text)


def fold_diacritics(text: str | Column) -> Column:
    """Lower case without combining marks. Only texts beyond ASCII go through Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, F.lower(text)).otherwise(_fold(F.when(~plain, text)))


def tokenize(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def folded_tokens(text: str | Column) -> Column:
    """The inverted index's tokens: without diacritics."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(fold_diacritics(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def build_postings(messages: DataFrame, keys: tuple[str, ...] = ("peer_id", "message_id"), text: str = "text") -> DataFrame:
    """(token, keys, tf, positions, dl) of active and edited messages."""
    rows = messages.where("state in ('active', 'edited')") if "state" in messages.columns else messages
    rows = rows.where(F.col(text).isNotNull()).select(*keys, folded_tokens(text).alias("_tokens"))
    rows = rows.select(*keys, F.size("_tokens").alias("dl"), F.posexplode("_tokens").alias("pos", "token"))
    return rows.groupBy("token", *keys, "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def refresh_postings(postings: DataFrame, messages: DataFrame, changed: DataFrame, keys: tuple[str, ...] = ("peer_id", "message_id")) -> DataFrame:
    """The index after the messages of `changed` (keys) were added, edited, deleted or restored."""
    touched = changed.select(*keys).distinct()
    kept = postings.join(touched, list(keys), "left_anti").select(*postings.columns)
    return kept.unionByName(build_postings(messages.join(touched, list(keys), "left_semi"), keys))


def query_terms(query: str) -> list[tuple[str, bool]]:
    """(token, is_prefix) of a query, all of them wanted; `word*` is a prefix."""
    found = []
    for part in query.split():
        word = folded(part)
        prefix, word = word.endswith("*"), "".join(c if c.isalnum() else " " for c in word)
        found += [(w, prefix) for w in word.split()]
    return found


def search_texts(messages: DataFrame, query: str, keys: tuple[str, ...] = ("peer_id", "message_id"), text: str = "text") -> DataFrame:
    """What search finds and how it ranks, from the texts themselves, for a table without an index.

    Each text's tokens are counted where they are, so that only one row of counts is ever shuffled.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    rows = messages.where("state in ('active', 'edited')") if "state" in messages.columns else messages
    if not terms:
        return rows.select(*keys, F.lit(0.0).alias("rank")).limit(0)
    hit = lambda word, prefix: lambda t: t.startswith(word) if prefix else t == word
    # inlined from an array of one, so that a text is split once and not for each count
    counts = lambda t: F.struct(F.size(t).alias("_dl"), *(F.size(F.filter(t, hit(*term))).alias(f"_tf{n}") for n, term in enumerate(terms)))
    rows = rows.where(F.col(text).isNotNull()).select(*keys, F.inline(F.transform(F.array(folded_tokens(text)), counts))).where("_dl > 0")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *(F.count_if(F.col(f"_tf{n}") > 0).alias(f"_df{n}") for n in range(len(terms))))
    found = rows.where(functools.reduce(lambda a, b: a & b, (F.col(f"_tf{n}") > 0 for n in range(len(terms))))).crossJoin(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for n in range(len(terms)):
        df, tf = F.col(f"_df{n}"), F.col(f"_tf{n}")
        rank = rank + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return found.select(*keys, rank.alias("rank"))


def search(postings: DataFrame, query: str, keys: tuple[str, ...] = ("peer_id", "message_id")) -> DataFrame:
    """Documents with every query term, and their BM25 rank (higher is better). A blank query finds nothing."""
    terms = list(dict.fromkeys(query_terms(query)))
    if not terms:
        return postings.select(*keys, F.lit(0.0).alias("rank")).limit(0)
    wanted = [F.col("token").startswith(word) if prefix else F.col("token") == word for word, prefix in terms]
    # a token counts for every term that it matches
    hits = postings.where(functools.reduce(lambda a, b: a | b, wanted)).withColumn("term", F.explode(F.array_compact(F.array(*(F.when(w, n) for n, w in enumerate(wanted))))))
    per_doc = hits.groupBy(*keys, "dl", "term").agg(F.sum("tf").alias("tf"))
    stats = postings.select(*keys, "dl").distinct().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    df = per_doc.groupBy("term").agg(F.count("*").alias("df"))
    scored = per_doc.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a query term, and one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    found = scored.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(idf * weight).alias("rank"))
    return found.where(F.col("_n") == len(terms)).drop("_n")


def phrase_matches(postings: DataFrame, phrase: str, keys: tuple[str, ...] = ("peer_id", "message_id")) -> DataFrame:
    """Documents where the phrase's words stand one after another."""
    words = [w for w, _ in query_terms(phrase)]
    found = None
    for n, word in enumerate(words):
        part = postings.where(F.col("token") == word).select(*keys, F.explode("positions").alias("pos")).withColumn("start", F.col("pos") - n).select(*keys, "start")
        found = part if found is None else found.join(part, [*keys, "start"])
    return postings.select(*keys).limit(0) if found is None else found.select(*keys).distinct()


def parse_query(query: str) -> list[tuple[list[list[str]], bool]]:
    """Clauses that must all hold: (alternatives, negated). An alternative is a word, a prefix (`word*`) or a phrase's words.

    Words stand side by side for AND; OR joins the ones beside it; NOT excludes the next; quotes make a phrase.
    """
    found, joined, negated = [], False, False
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if word in ("OR", "NOT", "AND"):
            joined, negated = joined or word == "OR", negated or word == "NOT"
            continue
        terms = query_terms(quoted or word)
        if not terms:
            continue
        alternative = [w for w, _ in terms] if quoted or len(terms) > 1 else [terms[0][0] + "*" * terms[0][1]]
        if joined and found and not negated:
            found[-1][0].append(alternative)
        else:
            found.append(([alternative], negated))
        joined = negated = False
    return found


def match_query(postings: DataFrame, query: str, keys: tuple[str, ...] = ("peer_id", "message_id")) -> DataFrame:
    """Keys of the documents that match a query with AND, OR, NOT, phrases and prefixes. Something must be wanted, not only excluded."""
    clauses = parse_query(query)
    nothing = postings.select(*keys).limit(0)

    def one(alternative: list[str]) -> DataFrame:
        if len(alternative) > 1:
            return phrase_matches(postings, " ".join(alternative), keys)
        word = alternative[0]
        rule = F.col("token").startswith(word[:-1]) if word.endswith("*") else F.col("token") == word
        return postings.where(rule).select(*keys).distinct()

    found = None
    for alternatives, negated in sorted(clauses, key=lambda c: c[1]):
        rows = one(alternatives[0])
        for more in alternatives[1:]:
            rows = rows.union(one(more)).distinct()
        if negated:
            found = nothing if found is None else found.join(rows, list(keys), "left_anti")
        else:
            found = rows if found is None else found.join(rows, list(keys), "left_semi")
    return nothing if found is None else found


def search_messages(messages: DataFrame, postings: DataFrame, query: str, peer: int | None = None, sender: int | None = None, start: int | None = None, end: int | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """The best messages for a query of plain words and prefixes, within a chat, sender and dates; newest first among equals."""
    rows = messages.select("peer_id", "message_id", "sender_id", "date", "text")
    for column, rule in (("peer_id", peer), ("sender_id", sender)):
        rows = rows if rule is None else rows.where(F.col(column) == rule)
    rows = rows if start is None else rows.where(F.col("date") >= start)
    rows = rows if end is None else rows.where(F.col("date") <= end)
    found = rows.join(search(postings, query), ["peer_id", "message_id"]).orderBy(F.desc("rank"), F.desc("date"), "peer_id", "message_id")
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def snippet(text: str | Column, words: list[str], size: int = 32) -> Column:
    """`size` words around the first hit, hits in <b>, cut ends as `...`."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"\s+")
    wanted = F.array(*map(F.lit, words))
    plain = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    first = F.array_position(F.transform(parts, lambda w: F.array_contains(wanted, plain(w))), True)
    start = F.greatest(F.lit(1), first.cast("int") - size // 4)
    shown = F.transform(F.slice(parts, start, F.lit(size)), lambda w: F.when(F.array_contains(wanted, plain(w)), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return F.concat(F.when(start > 1, "... ").otherwise(""), F.array_join(shown, " "), F.when(F.size(parts) >= start + size, " ...").otherwise(""))


def entry_senders(messages: DataFrame, peers: DataFrame, names: DataFrame) -> DataFrame:
    """The sender's name as the index has it: the peer's own, `User <id>` without one, and the chat's where no sender is known."""
    who = peers.select(F.col("peer_id").alias("sender_id"), F.col("name").alias("_own"))
    rows = messages.select("peer_id", "message_id", "sender_id").join(who, "sender_id", "left").join(names, "peer_id", "left")
    name = F.when(F.col("sender_id").isNotNull(), F.coalesce("_own", F.concat(F.lit("User "), F.col("sender_id").cast("string")))).otherwise(F.col("display_name"))
    return rows.select("peer_id", "message_id", name.alias("sender_name"))


def message_kinds(links: DataFrame, media: DataFrame) -> DataFrame:
    """peer_id, message_id, kinds: the kinds of a message's media, each once."""
    return links.join(media.select("media_id", "kind"), "media_id").groupBy("peer_id", "message_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def search_entries(messages: DataFrame, senders: DataFrame, names: DataFrame, kinds: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One entry per message that isn't empty or inaccessible: sorted distinct tokens of text, sender and chat; media kinds; flags; url.

    Deleted messages and those without text have entries too. senders: (peer_id, message_id, sender_name); names: (peer_id,
    display_name); kinds: (peer_id, message_id, kinds); pages: (peer_id, message_id, page_no), 0 where a message has none.
    """
    rows = messages.where("state is null or state not in ('empty', 'inaccessible')").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.join(senders, ["peer_id", "message_id"], "left").join(names, "peer_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.join(kinds, ["peer_id", "message_id"], "left") if kinds is not None else rows.withColumn("kinds", none)
    if pages is not None:
        rows = rows.join(pages.select("peer_id", "message_id", "page_no"), ["peer_id", "message_id"], "left")
    page = F.coalesce("page_no", F.lit(0)) if pages is not None else F.lit(0)
    url = F.concat(peer_dir("peer_id"), F.lit("/"), page_file(page), F.lit("#"), message_anchor("peer_id", "message_id"))
    tokens = F.array_sort(F.array_distinct(F.concat(tokenize("text"), F.coalesce(tokenize("sender_name"), none), F.coalesce(tokenize("display_name"), none))))
    forwarded = F.col("forward_json").isNotNull() if "forward_json" in messages.columns else F.lit(False)
    return rows.select(
        "peer_id", "message_id", "date", "sender_name", F.col("display_name").alias("chat_name"), "text", "state", tokens.alias("tokens"), F.coalesce("kinds", none).alias("media_kinds"),
        F.col("reply_to_msg_id").isNotNull().alias("is_reply"), forwarded.alias("is_fwd"), url.alias("url"),
    )


def prefix_index(entries: DataFrame, longest: int = 3) -> DataFrame:
    """(prefix, shard_id) for prefixes of 1 to `longest` characters of every token."""
    tokens = entries.select("shard_id", F.explode("tokens").alias("token")).distinct()
    return tokens.select("shard_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("prefix")).distinct().select("prefix", "shard_id")


def candidate_shards(prefixes: DataFrame, stats: DataFrame, query: str, start: int | None = None, end: int | None = None, longest: int = 3, peer: int | None = None) -> DataFrame:
    """Shards that hold every query token's prefix, overlap the date range and have entries of the chat."""
    words = sorted({w[:longest] for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    rows = stats
    if words:
        rows = rows.join(prefixes.where(F.col("prefix").isin(words)).groupBy("shard_id").agg(F.countDistinct("prefix").alias("_n")).where(F.col("_n") == len(words)), "shard_id").drop("_n")
    if peer is not None:
        rows = rows.where(F.array_contains("peer_ids", F.lit(peer).cast("long")))
    if start is not None:
        rows = rows.where(F.col("max_date") >= start)
    return rows if end is None else rows.where(F.col("min_date") <= end)


def score_entries(entries: DataFrame, query: str) -> DataFrame:
    """Entries with every query token as a token or its prefix. 100: the phrase stands in the text; 50: all exact; else 20 + 5 an exact one.

    A query without letters or digits matches nothing.
    """
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    rows, exact = entries.where(F.lit(bool(words))), F.lit(0)
    begins = lambda w: F.exists("tokens", lambda t: t.startswith(w))
    for w in words:
        rows = rows.where(begins(w))
        exact = exact + F.array_contains("tokens", w).cast("int")
    score = F.when(F.contains(F.lower("text"), F.lit(query.lower().strip())), 100).when(exact == len(words), 50).otherwise(20 + 5 * exact)
    return rows.withColumn("score", score.cast("int"))


def top_matches(scored: DataFrame, k: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("date"), "peer_id", "message_id").limit(k)


def faceted_search(entries: DataFrame, query: str, k: int = 50, peer: int | None = None, sender: str | None = None, start: int | None = None, end: int | None = None, is_reply: bool | None = None, state: str | None = None, is_fwd: bool | None = None, media: str | None = None) -> DataFrame:
    """Filters, then scores, then the best k. Without text every entry that passes the filters scores 1."""
    rows = entries
    for rule in (
        peer is not None and F.col("peer_id") == peer, sender is not None and F.contains(F.lower("sender_name"), F.lit((sender or "").lower())), start is not None and F.col("date") >= start,
        end is not None and F.col("date") <= end, is_reply is not None and F.col("is_reply") == F.lit(is_reply), state is not None and F.col("state") == state,
        is_fwd is not None and F.col("is_fwd") == F.lit(is_fwd), media is not None and F.array_contains("media_kinds", media),
    ):
        if rule is not False:
            rows = rows.where(rule)
    return top_matches(score_entries(rows, query) if query.strip() else rows.withColumn("score", F.lit(1)), k)


def highlight(text: str, word: str, before: int = 50, after: int = 170, plain: int = 220) -> Column:
    """A window around the first hit with every hit in <mark>; the text's start if there is none.

    The word is taken literally, in any case, and looked for in the text itself, not in its escapes. A blank word
    has no hits.
    """
    whole = F.translate(F.col(text), OPEN + CLOSE, "")
    at = F.instr(F.lower(whole), word.lower()) if word else F.lit(0)
    start = F.greatest(F.lit(1), at - before)
    part = F.when(at > 0, F.substring(whole, start, at - start + after)).otherwise(F.substring(whole, 1, plain))
    if word:
        quoted = word.replace("\\E", "\\E\\\\E\\Q")
        part = F.regexp_replace(part, f"(?iu)(\\Q{quoted}\\E)", f"{OPEN}$1{CLOSE}")
    for char, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (OPEN, "<mark>"), (CLOSE, "</mark>")):
        part = F.replace(part, F.lit(char), F.lit(shown))
    return part


#: Private characters that stand for the tags while a text is escaped.
OPEN, CLOSE = "\ue000", "\ue001"
