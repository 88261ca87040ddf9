"""The reply graph: every message answers at most one, so walks are followed by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import reply_edges
from .staging import scratch, staged


def _node(peer: str, message: str):
    return F.struct(F.col(peer).alias("peer_id"), F.col(message).alias("message_id"))


def replies_to(messages: DataFrame) -> DataFrame:
    """Incoming replies of each target."""
    return reply_edges(messages).groupBy("target_peer_id", "target_message_id").agg(F.count("*").alias("n_replies"), F.min("source_message_id").alias("first_reply_id"))


def self_replies(messages: DataFrame) -> DataFrame:
    return messages.where("reply_to_msg_id = message_id and coalesce(reply_to_peer_id, peer_id) = peer_id").select("peer_id", "message_id")


def _settled(jump: DataFrame, hops: int) -> tuple:
    """What stays the same in a doubling only once all walks have ended or gone round their cycle.

    A longer chain has nodes of every depth, so more walks would end; a longer tail would leave fewer
    nodes to stand on; a longer cycle would show someone a lesser member.
    """
    endless = F.col("hops") >= hops
    return tuple(jump.agg(F.count(F.when(~endless, 1)), F.count_distinct(F.when(endless, F.col("to"))), F.sum(F.when(endless, F.xxhash64("least")).cast("decimal(38,0)"))).first())


def walks(messages: DataFrame, most_hops: int = 1024, folder: str | None = None) -> DataFrame:
    """For each message: root or a node of its cycle, hops, least node seen, and whether the walk ends.

    Step k doubles pointers of 2**k hops: ten joins for 1,024 hops. Walks that have ended are left where they were
    written, so a step joins and writes only those still under way. Once most_hops is reached it is looked whether any goes
    on, and doubling lasts until none does, by the logarithm of the longest walk. Self replies count as roots.
    Each step is keyed by the message, and a chat's size doesn't matter.
    """
    edges = reply_edges(messages).where("status = 'resolved' and not (source_peer_id = target_peer_id and source_message_id = target_message_id)")
    jump = messages.select(_node("peer_id", "message_id").alias("node")).join(
        edges.select(_node("source_peer_id", "source_message_id").alias("node"), _node("target_peer_id", "target_message_id").alias("next")), "node", "left")
    jump = jump.select("node", F.coalesce("next", "node").alias("to"), F.col("next").isNotNull().cast("long").alias("hops"), F.least("node", F.coalesce("next", "node")).alias("least"))
    folder = folder or scratch(messages.sparkSession)
    ended, step, state = None, 1, None
    while True:
        jump = staged(jump, folder, str(step))
        stops, open_ = jump.where(F.col("hops") < step), jump.where(F.col("hops") >= step)
        ended = stops if ended is None else ended.union(stops)
        every = ended.union(open_)
        before = state
        if step >= most_hops:
            state = _settled(every, step)
        if open_.isEmpty() or (state is not None and state == before):
            return every.withColumn("ends", F.col("hops") < step)
        ahead = every.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"))
        jump = open_.join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("least", "least2").alias("least"))
        step *= 2


def reply_depth(found: DataFrame, most_hops: int = 1024) -> DataFrame:
    """Depth and thread root of each message; walks that lead into a cycle have neither. most_hops is no limit."""
    ends = F.col("ends")
    return found.select("node.peer_id", "node.message_id", F.when(ends, F.col("hops")).alias("depth"), F.when(ends, F.col("to.peer_id")).alias("root_peer_id"), F.when(ends, F.col("to.message_id")).alias("root_message_id"))


def reply_cycles(found: DataFrame, messages: DataFrame, most_hops: int = 1024, folder: str | None = None) -> DataFrame:
    """True cycles of any size: their least member, number of members, and of tails that lead into them.

    A walk that doesn't end stands on a cycle's node, whose own walk comes back to it: those
    nodes are the members. most_hops is no limit.
    """
    folder = folder or scratch(messages.sparkSession)
    endless = staged(found.where("not ends"), folder, "endless")
    edges = reply_edges(messages).where("status = 'resolved'").select(_node("source_peer_id", "source_message_id").alias("node"), _node("target_peer_id", "target_message_id").alias("next"))
    inside = endless.select(F.col("to").alias("node")).distinct()
    # a cycle's members are the nodes on which endless walks stand, closed under one more step
    members = inside.join(edges, "node").select("node", "next").join(endless.select("node", "least"), "node").select("node", "next", "least")
    members = staged(members, folder, "members")
    # members are closed under their links
    closed = members.join(members.select(F.col("node").alias("next"), F.col("least").alias("_l")), "next").where("least = _l").groupBy("least").agg(F.count("*").alias("n_closed"))
    cycles = members.groupBy("least").agg(F.count("*").alias("n_members")).join(closed, "least").where("n_members = n_closed").drop("n_closed")
    walkers = endless.join(members.select(F.col("node").alias("to"), F.col("least").alias("cycle")), "to").groupBy("cycle").agg(F.count("*").alias("n_walkers"))
    rows = cycles.join(walkers, cycles["least"] == walkers["cycle"])
    return rows.select("least.peer_id", "least.message_id", "n_members", (F.col("n_walkers") - F.col("n_members")).alias("tail_count"))


def deep_chains(found: DataFrame, limit: int = 1000, most_hops: int = 1024) -> DataFrame:
    """Messages whose chain reaches `limit` replies without a cycle."""
    return reply_depth(found, most_hops).where(F.col("depth") >= limit).select("peer_id", "message_id", "depth")


def discover_topics(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Forum topics: the general one, ids seen in reply_to_top_id, and created ones with their last edits.

    events: (peer_id, message_id, topic_id, action create or edit, title, closed, pinned).
    """
    seen = messages.where("reply_to_top_id is not null").select("peer_id", F.col("reply_to_top_id").alias("topic_id"))
    general = messages.select("peer_id").distinct().withColumn("topic_id", F.lit(1).cast("long"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("message_id"))).alias(c)
    told = events.groupBy("peer_id", "topic_id").agg(last("title"), last("closed"), last("pinned"))
    ids = seen.union(general).union(told.select("peer_id", "topic_id")).distinct()
    rows = ids.join(told, ["peer_id", "topic_id"], "left")
    title = F.coalesce("title", F.when(F.col("topic_id") == 1, F.lit("General")).otherwise(F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))))
    return rows.select("peer_id", "topic_id", title.alias("title"), F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def message_topic(messages: DataFrame, created: DataFrame) -> DataFrame:
    """Each message's topic: its own id if it created one, the thread's top, a forum root it answers, else the general one."""
    own = created.select("peer_id", F.col("topic_id").alias("message_id"), F.lit(True).alias("_own"))
    root = created.select("peer_id", F.col("topic_id").alias("reply_to_msg_id"), F.lit(True).alias("_root"))
    rows = messages.join(own, ["peer_id", "message_id"], "left").join(root, ["peer_id", "reply_to_msg_id"], "left")
    topic = F.when(F.col("_own"), F.col("message_id")).when(F.col("reply_to_top_id").isNotNull(), F.col("reply_to_top_id")).when(F.col("_root"), F.col("reply_to_msg_id")).otherwise(F.lit(1))
    return rows.select("peer_id", "message_id", topic.cast("long").alias("topic_id"))


def relation_kind(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """What kind of answer each reply is."""
    rows = messages.where("reply_to_msg_id is not null").join(peers.select("peer_id", "peer_type"), "peer_id", "left")
    other = F.col("reply_to_peer_id").isNotNull() & (F.col("reply_to_peer_id") != F.col("peer_id"))
    top = F.col("reply_to_top_id").isNotNull() if "reply_to_top_id" in messages.columns else F.lit(False)
    kind = F.when(other & (F.col("peer_type") == "channel"), "channel_discussion").when(other, "cross_chat").when(top & (F.col("peer_type") == "group"), "forum_topic").when(top, "comment_thread").otherwise("direct_reply")
    return rows.select("peer_id", "message_id", kind.alias("relation"))
