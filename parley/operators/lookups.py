"""Point lookups, listings and top-k selections over the archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_rows(table: DataFrame, **key) -> DataFrame:
    """Rows whose columns equal the given key; the filter reaches the parquet scan."""
    for column, value in key.items():
        table = table.where(F.col(column) == F.lit(value))
    return table


def list_messages(messages: DataFrame, peer_id: int, limit: int, after: int | None = None, offset: int = 0) -> DataFrame:
    """A chat's messages by id. after: the last id of the page before, which is cheaper than an offset."""
    rows = messages.where(F.col("peer_id") == peer_id)
    if after is not None:
        rows = rows.where(F.col("message_id") > after)
    rows = rows.orderBy("message_id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def list_message_dates(messages: DataFrame, peer_id: int) -> DataFrame:
    return messages.where(F.col("peer_id") == peer_id).select("message_id", "date").orderBy("message_id")


def list_revisions(revisions: DataFrame, peer_id: int, message_id: int) -> DataFrame:
    """A message's history, oldest first."""
    return get_rows(revisions, peer_id=peer_id, message_id=message_id).orderBy("revision_no")


def list_peers(peers: DataFrame, peer_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; ties by id."""
    rows = peers if peer_type is None else peers.where(F.col("peer_type") == peer_type)
    rows = rows.orderBy(F.desc("updated_at"), "peer_id")
    return rows if limit is None else rows.limit(limit)


def peers_of_kind(peers: DataFrame, channels: bool) -> DataFrame:
    """Ids of channels, or of users and groups."""
    return peers.where(F.col("peer_type").isin("channel") if channels else F.col("peer_type").isin("user", "group")).select("peer_id")


def date_range(rows: DataFrame, start: int | None = None, end: int | None = None, peers: list[int] | None = None) -> DataFrame:
    """Rows with start <= date <= end; an open bound is None."""
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if end is not None:
        rows = rows.where(F.col("date") <= end)
    return rows if peers is None else rows.where(F.col("peer_id").isin(peers))


def visible(include_service: bool = True, include_deleted: bool = False) -> Column:
    """The export's visibility rule."""
    rule = F.lit(True) if include_service else ~F.coalesce(F.col("is_service"), F.lit(False))
    return rule if include_deleted else rule & (F.col("state") != "deleted")


def visible_messages(messages: DataFrame, **options) -> DataFrame:
    return messages.where(visible(**options))


def media_by_status(media: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Oldest first."""
    rows = media.where(F.col("download_status") == status).orderBy("created_at", "media_id")
    return rows if limit is None else rows.limit(limit)


def media_by_hash(media: DataFrame) -> DataFrame:
    """The first completed object of each content hash."""
    return media.where("download_status = 'completed' and sha256 is not null").groupBy("sha256").agg(F.min("media_id").alias("media_id"))


def title_changes(messages: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Per chat the first message whose text starts with a pattern, and the text between its first and last quote."""
    rule = F.lit(False)
    for p in patterns:
        rule = rule | F.col("text").startswith(p)
    first = messages.where(rule).groupBy("peer_id").agg(F.min(F.struct("message_id", "text")).alias("m"))
    return first.select("peer_id", F.col("m.message_id").alias("message_id"), F.nullif(F.regexp_extract("m.text", '"(.*)"', 1), F.lit("")).alias("title"))


def latest_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest `order` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def download_worklist(media: DataFrame, now: int, limit: int) -> DataFrame:
    """Pending objects first, then due retries, which are those without a time too; fewest retries, oldest."""
    due = (F.col("download_status") == "pending") | ((F.col("download_status") == "retry_wait") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    rows = media.where(due).orderBy(F.when(F.col("download_status") == "pending", 0).otherwise(1), "retry_count", "created_at", "media_id")
    return rows.limit(limit).select("media_id", "download_status", "retry_count", "created_at")


def best_photo_size(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Per photo the size with the largest area, then the most bytes, then the first; the wider and then the higher of those, so that no order of rows decides."""
    rank = F.struct((F.col("width").cast("long") * F.col("height")).alias("area"), F.coalesce("bytes", F.lit(0)).alias("b"), (-F.col("ordinal")).alias("o"), F.col("width").alias("w"), F.col("height").alias("h"))
    rest = [c for c in sizes.columns if c not in keys]
    return sizes.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")
