"""Large JSON exports, read by many tasks: one file is cut at the borders of its messages.

Spark's text source splits a file anywhere if its lines end at opening braces. Whether a brace stands in a string, and how deep, depends
on everything before it; but a piece of text says on its own how it changes that: by the parity of its quotes, and by the
brackets outside of strings if it begins in one or not. So running sums over the pieces of a block, for either way in which it may begin,
and then over the blocks, tell each brace's place. Braces at the depth of messages begin a message; the pieces up to the next one are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.staging import staged
from .schemas import EXPORT

_HEADER = "name string, type string, id long"
_MESSAGE = EXPORT.split("messages array<", 1)[1].split(">>, chats ", 1)[0] + ">"


def _pieces(spark: SparkSession, path: str, split_bytes: int | None) -> DataFrame:
    """file, _block (where the block of the piece begins), at (order within a block) and value: the text after each opening brace, and that before the first."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        if split_bytes:
            spark.conf.set(key, str(split_bytes))
        rows = spark.read.option("lineSep", "{").text(path)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("at"), "value")
        # small blocks go into a file by sixteens
        blocks = rows.rdd.getNumPartitions()
        return staged(rows.coalesce(max(-(-blocks // 16), min(blocks, 4 * spark.sparkContext.defaultParallelism))))
    finally:
        spark.conf.set(key, before)


def _opened(text: str) -> Column:
    """By how many levels a text without strings and opening braces goes deeper."""
    count = lambda c: F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))
    return count("[") - count("]") - count("}")


def _in_block() -> WindowSpec:
    return Window.partitionBy("file", "_block").orderBy("at")


def _so_far() -> WindowSpec:
    """The pieces of a block up to and with a piece."""
    return _in_block().rowsBetween(Window.unboundedPreceding, 0)


def _measured(pieces: DataFrame) -> DataFrame:
    """What pieces say of themselves and, as running sums within their block, of their depth: for blocks that begin outside of strings (0) or in one (1)."""
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    rows = pieces.withColumn("_bare", bare).withColumns({"quotes": F.length("_bare") - F.length(F.replace(F.col("_bare"), F.lit('"'), F.lit(""))), "_rest": F.regexp_replace("_bare", r'\A[^"]*("|\z)', "")})
    text = lambda c: F.regexp_replace(c, r'"[^"]*("|\z)', "")
    rows = rows.withColumns({"_outside": text("_bare"), "_inside": text("_rest")}).withColumns({"outside": _opened("_outside"), "inside": _opened("_inside")}).drop("_bare", "_rest", "_outside", "_inside")
    # the first piece of a file has no brace before it
    rows = rows.withColumns({"first": (F.col("_block") == 0) & (F.row_number().over(_in_block()) == 1), "odd": (F.sum("quotes").over(_so_far()) - F.col("quotes")) % 2 == 1})
    for start, in_string in ((0, F.col("odd")), (1, ~F.col("odd"))):
        rows = rows.withColumn(f"opened{start}", F.when(in_string, F.col("inside")).otherwise(F.col("outside")))
        rows = rows.withColumn(f"after{start}", F.sum(F.col(f"opened{start}") + (~in_string & ~F.col("first")).cast("int")).over(_so_far()))
    shows = F.when(F.contains("value", F.lit('"chats"')), F.col("value").rlike(r'"chats"\s*:\s*$')).otherwise(F.lit(False))
    return rows.withColumn("shows_chats", shows).drop("inside", "outside")


def _placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Measured pieces with brace, depth and depth_after, from where their blocks begin."""
    rows = rows.join(blocks, ["file", "_block"])
    of = lambda name: F.when(F.col("starts_in_string"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    in_string = F.col("odd") != F.col("starts_in_string")
    after = F.col("starts_at") + of("after")
    return rows.withColumns({"brace": ~in_string & ~F.col("first"), "depth_after": after, "depth": after - of("opened")})


def split_export(spark: SparkSession, path: str, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) of exports: file, chat_no, name, type, id; and file, chat_no, m, the message as declared in EXPORT.

    split_bytes: about how much of a file a task reads; Spark's own setting if None. Files must not be compressed.
    """
    rows = staged(_measured(_pieces(spark, path, split_bytes)))
    # a row for each block
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = rows.groupBy("file", "_block").agg(F.sum("quotes").alias("_quotes"), *(F.max_by(f"after{k}", "at").alias(f"_after{k}") for k in (0, 1)))
    blocks = blocks.withColumn("starts_in_string", before("_quotes") % 2 == 1)
    blocks = staged(blocks.withColumn("starts_at", before(F.when(F.col("starts_in_string"), F.col("_after1")).otherwise(F.col("_after0")))).select("file", "_block", "starts_in_string", "starts_at"))
    # an account's export has its chats in a list, and these their messages; another is a chat itself
    full = _placed(rows.where("shows_chats"), blocks).where("depth_after = 1").select("file").distinct().withColumn("full", F.lit(True))
    blocks = blocks.join(full, "file", "left").withColumn("full", F.col("full").isNotNull())
    chat, message = F.when(F.col("full"), 4).otherwise(1), F.when(F.col("full"), 6).otherwise(3)
    begins = {"is_chat": F.col("brace") & (F.col("depth") == chat), "is_message": F.col("brace") & (F.col("depth") == message)}
    begun = _placed(rows.drop("value"), blocks).withColumns(begins).where("is_chat or is_message")
    begun = begun.groupBy("file", "_block").agg(F.count_if("is_chat").alias("_chats"), F.count("*").alias("_units"), F.max_by("is_message", "at").alias("_kind"))
    blocks = blocks.join(begun, ["file", "_block"], "left")
    blocks = staged(blocks.select("file", "_block", "starts_in_string", "starts_at", "full", before("_chats").alias("chats_before"), before("_units").alias("units_before"), F.last("_kind", ignorenulls=True).over(earlier).alias("kind_before")))
    rows = _placed(rows, blocks).withColumns(begins)
    rows = rows.withColumns({
        "chat_no": F.col("chats_before") + F.count_if("is_chat").over(_so_far()), "unit": F.col("units_before") + F.count_if(F.col("is_chat") | F.col("is_message")).over(_so_far()),
        "kind": F.coalesce(F.last(F.when(F.col("is_chat") | F.col("is_message"), F.col("is_message")), ignorenulls=True).over(_so_far()), F.col("kind_before")),
    })
    # what stands behind a message or a chat is no part of it
    own = rows.where((F.col("unit") > 0) & (F.col("depth") >= F.when(F.col("kind"), message).otherwise(chat)))
    units = own.groupBy("file", "chat_no", "unit", F.col("kind").alias("is_message")).agg(F.array_sort(F.collect_list(F.struct("_block", "at", "value"))).alias("l"))
    units = staged(units.select("file", "chat_no", "is_message", F.concat(F.lit("{"), F.array_join("l.value", "{")).alias("json")))
    heads = units.where("not is_message").where(F.col("json").rlike(r'"messages"\s*:\s*\['))
    heads = heads.select("file", "chat_no", F.from_json(F.regexp_replace("json", r'"messages"\s*:\s*\[\s*$', '"messages": []}'), _HEADER).alias("h")).select("file", "chat_no", "h.*")
    messages = units.where("is_message").select("file", "chat_no", F.from_json("json", _MESSAGE).alias("m"))
    return heads, messages.join(heads.select("file", "chat_no"), ["file", "chat_no"], "left_semi")
