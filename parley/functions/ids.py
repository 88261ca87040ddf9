"""Column expressions for identifiers, file names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = -1_000_000_000_000


def encode_peer(kind: str | Column, number: str | Column) -> Column:
    """The archive's id of a user, group or channel."""
    k, n = (F.col(x) if isinstance(x, str) else x for x in (kind, number))
    return F.when(k == "channel", F.lit(CHANNELS) - n).when(k == "group", -n).otherwise(n)


def peer_kind(peer_id: str | Column) -> Column:
    p = F.col(peer_id) if isinstance(peer_id, str) else peer_id
    return F.when(p <= CHANNELS, "channel").when(p < 0, "group").otherwise("user")


def decode_peer(peer_id: str | Column) -> Column:
    """The plain number of an id."""
    p = F.col(peer_id) if isinstance(peer_id, str) else peer_id
    return F.when(p <= CHANNELS, F.lit(CHANNELS) - p).when(p < 0, -p).otherwise(p)


def parse_peer(text: str | Column) -> Column:
    """user123, chat7 and channel5 as ids; null for anything else."""
    t = F.col(text) if isinstance(text, str) else text
    number = F.regexp_extract(t, r"^(?:user|chat|channel)(\d+)$", 1).try_cast("long")
    return F.when(t.startswith("channel"), F.lit(CHANNELS) - number).when(t.startswith("chat"), -number).otherwise(number)


def peer_token(peer_id: str) -> Column:
    """A name for files: u, g or c and the number."""
    return F.concat(F.substring(peer_kind(peer_id), 1, 1), decode_peer(peer_id).cast("string"))


def message_anchor(peer_id: str, message_id: str) -> Column:
    return F.concat(F.lit("msg-"), peer_token(peer_id), F.lit("-"), F.col(message_id).cast("string"))


def page_file(page_no: str | Column) -> Column:
    p = F.col(page_no) if isinstance(page_no, str) else page_no
    return F.concat(F.lit("page-"), F.lpad((p + 1).cast("string"), 4, "0"), F.lit(".html"))


def topic_page_file(topic_id: str, page_no: str) -> Column:
    return F.concat(F.lit("topic-"), F.col(topic_id).cast("string"), F.lit("/"), page_file(page_no))


def peer_dir(peer_id: str) -> Column:
    return F.concat(F.lit("chats/"), peer_token(peer_id))


def ymd(date: str) -> Column:
    return F.date_format(F.timestamp_seconds(date), "yyyy-MM-dd")


def format_utc(date: str) -> Column:
    return F.date_format(F.timestamp_seconds(date), "yyyy-MM-dd HH:mm:ss 'UTC'")


def short_time(date: str) -> Column:
    return F.date_format(F.timestamp_seconds(date), "HH:mm")


def date_bound(text: str | Column, is_end: bool) -> Column:
    """Epoch seconds of YYYY-MM-DD (its last second for an end) or of a timestamp, UTC unless it names an offset; null if it is neither."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    day = F.unix_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).try_cast("date")).cast("long") * 86400
    timed = F.regexp_replace(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), t), r"^(\S+[T ]\d{1,2}:\d{1,2})(?=$|[Z+-])", "$1:00")
    zoned = F.when(timed.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), timed).otherwise(F.concat(timed, F.lit("Z")))
    return F.coalesce(day + (86399 if is_end else 0), F.unix_timestamp(zoned.try_cast("timestamp")))


def _first_bytes(digest: Column) -> Column:
    """The first eight bytes of a hex digest as a number below 1e15."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(38,0)") % F.lit(10**15).cast("decimal(38,0)")).cast("long")


def synthetic_chat_id(source: str | Column, base: int = -2_000_000_000_000_000) -> Column:
    """A stable id for a chat that has none, from what identifies its export."""
    s = F.col(source) if isinstance(source, str) else source
    return F.lit(base) - _first_bytes(F.sha2(s, 256))


def synthetic_sender_id(chat_id: str | Column, name: str | Column, base: int = -4_000_000_000_000_000) -> Column:
    """A stable id for a named sender of a chat: the digest of the chat's eight id bytes and the name."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (chat_id, name))
    raw = F.concat(F.unhex(F.lpad(F.hex(c), 16, "0")), F.encode(n, "UTF-8"))
    return F.lit(base) - _first_bytes(F.sha2(raw, 256))
