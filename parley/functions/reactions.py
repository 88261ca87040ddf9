"""Reaction JSON: wrapped or bare, of four kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_reactions(messages: DataFrame, column: str = "reactions_json") -> DataFrame:
    """(peer_id, message_id, reaction, count, chosen): emoji, custom:<id>, paid or unknown. Malformed JSON has none."""
    whole = F.try_parse_json(column)
    results = F.coalesce(F.try_variant_get(whole, "$.results", "array<variant>"), F.try_variant_get(whole, "$.MessageReactions.results", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    one = messages.select("peer_id", "message_id", F.explode(results).alias("r"))
    get = lambda path, kind: F.try_variant_get("r", path, kind)
    emoji = F.coalesce(get("$.reaction.emoji", "string"), get("$.reaction.Emoji.emoticon", "string"), get("$.emoji", "string"))
    custom = F.coalesce(get("$.reaction.custom_emoji_id", "string"), get("$.reaction.CustomEmoji.document_id", "string"))
    paid = F.coalesce(get("$.reaction.type", "string"), get("$.reaction", "string")).isin("paid", "Paid")
    name = F.when(emoji.isNotNull(), emoji).when(custom.isNotNull(), F.concat(F.lit("custom:"), custom)).when(paid, "paid").otherwise("unknown")
    return one.select("peer_id", "message_id", name.alias("reaction"), F.coalesce(get("$.count", "long"), F.lit(1)).alias("count"), get("$.chosen_order", "int").isNotNull().alias("chosen"))
