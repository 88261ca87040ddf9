"""Pages, albums, clusters and separators over each chat's messages.

A chat may hold a third of all rows and its ids may be far apart, so no window spans a chat's messages. The rows are cut
into ranges of (chat, id) of about equal size, whose borders are quantiles. A window works within a range, and what a
chat's ranges before it have to say, whatever can be summed up (a count, a maximum, a last value), comes from a table with a row
for each chat and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

CLUSTER_GAP = 600
#: How many ranges rows are cut into; None: as many as shuffles have partitions.
RANGES: int | None = None


def ranged(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """rows in ranges of keys and order, written that way; _block: a row's range."""
    return staged(rows.repartitionByRange(*([RANGES] if RANGES else []), *keys, order).withColumn("_block", F.spark_partition_id()))


def carried(rows: DataFrame, keys: tuple[str, ...], order: str = "message_id", **values: tuple) -> tuple[DataFrame, Window]:
    """(rows with a column for each value, the window of a row's own range in order).

    values: name=(aggregate of a range, function that sums up the chat's ranges before, or those after if a third item is true).
    Rows that have a _block already, from a pass before with these keys and this order, are not cut again.
    """
    if "_block" not in rows.columns:
        rows = ranged(rows, keys, order)
    blocks = rows.groupBy(*keys, "_block").agg(*(agg.alias(n) for n, (agg, *_) in values.items()))
    sequence = Window.partitionBy(*keys).orderBy("_block")
    spans = {n: sequence.rowsBetween(1, Window.unboundedFollowing) if after and after[0] else sequence.rowsBetween(Window.unboundedPreceding, -1) for n, (_, _, *after) in values.items()}
    blocks = blocks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), *(over(n).over(spans[n]).alias(n) for n, (_, over, *_) in values.items()))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(blocks, same, "left").drop("_b", *(f"_k{i}" for i in range(len(keys))))
    return rows, Window.partitionBy(*keys, "_block").orderBy(order)


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows before, in an order that is unique.

    The rows are dealt into ranges and written; each range starts at the sum of those before it, of which there are as many as partitions.
    """
    ranges = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranges.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside - F.col(value)).drop("_part", "_start")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Sorted rows with their places from 1: written as they lie, then each partition is moved by those before it."""
    marked = staged(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return marked.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def assign_pages(messages: DataFrame, chunk: int = 250, keys: tuple[str, ...] = ("peer_id",)) -> DataFrame:
    """page_no from 0: messages in id order, `chunk` a page, per chat or finer key."""
    rows, block = carried(messages, keys, _before=(F.count("*"), F.sum))
    place = F.coalesce("_before", F.lit(0)) + F.row_number().over(block) - 1
    return rows.withColumn("page_no", F.floor(place / chunk).cast("int")).drop("_before", "_block")


def day_of(date: str) -> Column:
    """Days since 1970 of a column of epoch seconds, truncated toward zero."""
    return F.expr(f"{date} div 86400")


def assign_day_pages(messages: DataFrame) -> DataFrame:
    """day_no from 1 in order of days, and the day page's file name. Only a chat's distinct days are ranked."""
    rows = messages.withColumn("day", day_of("date"))
    days = rows.select("peer_id", "day").distinct().withColumn("day_no", F.row_number().over(Window.partitionBy("peer_id").orderBy("day")))
    days = days.select(F.col("peer_id").alias("_peer"), F.col("day").alias("_day"), "day_no", F.concat(F.lit("day-"), F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"), F.lit(".html")).alias("day_file"))
    return rows.join(days, (F.col("peer_id") == F.col("_peer")) & F.col("day").eqNullSafe(F.col("_day")), "left").drop("_peer", "_day")


def date_index(pages: DataFrame) -> DataFrame:
    """The first page that holds each day. pages: messages with page_no."""
    return pages.withColumn("day", day_of("date")).groupBy("peer_id", "day").agg(F.min_by("page_no", "message_id").alias("page_no"), F.min("message_id").alias("message_id"))


def group_albums(messages: DataFrame) -> DataFrame:
    """Islands of consecutive rows with the same grouped_id: item_no, size and album flag per row."""
    rows, block = carried(messages, ("peer_id",), _last=(F.max_by(F.struct("grouped_id"), "message_id"), F.last))
    before = F.coalesce(F.lag(F.struct("grouped_id")).over(block), F.col("_last"))["grouped_id"]
    rows = rows.withColumn("_new", (F.col("grouped_id").isNull() | ~F.col("grouped_id").eqNullSafe(before)).cast("int")).drop("_last")
    rows, block = carried(rows, ("peer_id",), _items=(F.sum("_new"), F.sum))
    rows = rows.withColumn("item_no", F.coalesce("_items", F.lit(0)) + F.sum("_new").over(block.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_items", "_block")
    # rows of no group are items of their own
    sizes = rows.where("grouped_id is not null").groupBy(F.col("peer_id").alias("_peer"), F.col("item_no").alias("_item")).agg(F.count("*").alias("_size")).where("_size > 1")
    rows = rows.join(sizes, (F.col("peer_id") == F.col("_peer")) & (F.col("item_no") == F.col("_item")), "left")
    return rows.withColumn("item_size", F.coalesce("_size", F.lit(1))).withColumn("is_album", F.col("_size").isNotNull()).drop("_peer", "_item", "_size")


def album_continuation(pages: DataFrame) -> DataFrame:
    """Rows whose album goes on over a page edge. pages: messages with page_no."""
    what = F.struct("grouped_id", "page_no")
    rows, block = carried(pages, ("peer_id",), _last=(F.max_by(what, "message_id"), F.last), _next=(F.min_by(what, "message_id"), F.first, True))

    def across(step, beyond: str) -> Column:
        other = F.coalesce(step(what).over(block), F.col(beyond))
        return F.coalesce((other["grouped_id"] == F.col("grouped_id")) & (other["page_no"] != F.col("page_no")), F.lit(False))

    rows = rows.withColumn("continued", across(F.lag, "_last")).withColumn("continues", across(F.lead, "_next"))
    return rows.where("continued or continues").select("peer_id", "message_id", "page_no", "continued", "continues")


def sender_clusters(pages: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """First and last of each run of one sender within a page: at most `gap` seconds apart, no service rows between.

    Where messages say in which direction they went (is_outgoing), a run has one direction.
    """
    order = Window.partitionBy("peer_id", "page_no").orderBy("message_id")
    key = F.struct("sender_id", "is_service", "date", (F.col("is_outgoing") if "is_outgoing" in pages.columns else F.lit(False)).alias("is_outgoing"))

    def broken(step) -> Column:
        other = step(key).over(order)
        return other.isNull() | other["is_service"] | F.col("is_service") | ~other["sender_id"].eqNullSafe(F.col("sender_id")) | ~other["is_outgoing"].eqNullSafe(key["is_outgoing"]) | (F.abs(other["date"] - F.col("date")) > gap)

    return pages.select("peer_id", "message_id", "page_no", "sender_id", "is_service", broken(F.lag).alias("first_of_cluster"), broken(F.lead).alias("last_of_cluster"))


def show_sender(clusters: DataFrame, peers: DataFrame) -> DataFrame:
    """Whether a row shows its sender: in groups the first of a cluster; in private chats a sender other than the last one."""
    said = F.when(~F.col("is_service"), F.struct("sender_id"))
    rows, block = carried(clusters, ("peer_id",), _said=(F.max_by(said, F.when(said.isNotNull(), F.col("message_id"))), lambda c: F.last(c, ignorenulls=True)))
    rows = rows.withColumn("_last", F.coalesce(F.last(said, ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.col("_said")))
    last = F.col("_last")
    change = ~F.col("is_service") & (last.isNull() | ~last["sender_id"].eqNullSafe(F.col("sender_id")))
    shown = F.when(F.col("peer_type") == "user", change).when(F.col("peer_type") == "group", F.col("first_of_cluster") & F.col("sender_id").isNotNull() & ~F.col("is_service")).otherwise(F.lit(False))
    return rows.join(peers.select("peer_id", "peer_type"), "peer_id").select("peer_id", "message_id", shown.alias("show_sender"))


def date_separators(pages: DataFrame) -> DataFrame:
    """Rows where the day changes; the anchor is only given to a day's first separator on a page."""
    rows = pages.withColumn("day", day_of("date"))
    before = F.lag("day").over(Window.partitionBy("peer_id", "page_no").orderBy("message_id"))
    rows = rows.withColumn("_change", before.isNull() | (before != F.col("day"))).where("_change").drop("_change")
    first = F.row_number().over(Window.partitionBy("peer_id", "page_no", "day").orderBy("message_id")) == 1
    return rows.select("peer_id", "message_id", "page_no", "day", first.alias("has_anchor"))


def revision_order_check(revisions: DataFrame) -> DataFrame:
    """Revisions whose edit date goes back within their message."""
    order = Window.partitionBy("peer_id", "message_id").orderBy("revision_no")
    rows = revisions.withColumn("previous", F.lag("edit_date").over(order))
    return rows.where("previous > edit_date").select("peer_id", "message_id", "revision_no", "previous", "edit_date")


def entry_shards(entries: DataFrame, size: int = 2500) -> DataFrame:
    """shard_id of each entry in the order of (peer_id, message_id), without a window over a table or a chat.

    Entries are numbered within ranges of that order and moved by the entries of the ranges before.
    """
    rows = running_total(entries.withColumn("_one", F.lit(1)), ["peer_id", "message_id"], "_one", "_at")
    return rows.withColumn("shard_id", F.floor(F.col("_at") / size).cast("int")).drop("_at", "_one")


def prev_next_pages(pages: DataFrame) -> DataFrame:
    """Each page's neighbours."""
    found = pages.select("peer_id", "page_no").distinct()
    rows, block = carried(found, ("peer_id",), "page_no", _last=(F.max("page_no"), F.last), _next=(F.min("page_no"), F.first, True))
    return rows.select("peer_id", "page_no", F.coalesce(F.lag("page_no").over(block), F.col("_last")).alias("prev_page"), F.coalesce(F.lead("page_no").over(block), F.col("_next")).alias("next_page"))
