"""Latest-wins merges: one generic operator, and a rule set for each archive table.

A rule makes a column's new value from the base's and the change's. Rules are expressions over
b.<column> and c.<column>; a row that only one side has is taken as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERWRITE, COALESCE, KEEP, FIRST, GREATEST = "c.{0}", "coalesce(c.{0}, b.{0})", "b.{0}", "coalesce(b.{0}, c.{0})", "greatest(b.{0}, c.{0})"


def merge(base: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """base with changes applied: one change a key. Columns without a rule are overwritten."""
    b, c = base.withColumn("_b", F.lit(True)).alias("b"), changes.withColumn("_c", F.lit(True)).alias("c")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    columns = []
    for name in base.columns:
        if name in keys:
            columns.append(F.expr(f"coalesce(b.{name}, c.{name})").alias(name))
        elif name not in changes.columns:
            columns.append(F.col(f"b.{name}").alias(name))
        else:
            both = F.expr(rules.get(name, OVERWRITE).format(name))
            columns.append(F.when(F.col("c._c").isNull(), F.col(f"b.{name}")).when(F.col("b._b").isNull(), F.col(f"c.{name}")).otherwise(both).alias(name))
    return b.join(c, condition, "full").select(*columns)


def last_change(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key in arrival order."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*").select(*changes.columns)


#: Rule sets. What isn't listed is overwritten.
PEERS = {"raw": COALESCE}
PEERS_AUXILIARY = {"name": COALESCE, "username": COALESCE, "phone": COALESCE, "raw": COALESCE, "peer_type": KEEP}
MESSAGES = {"raw": COALESCE}
TOMBSTONES = {"pts": COALESCE, "pts_count": COALESCE, "observed_at": FIRST}
MESSAGE_MEDIA: dict[str, str] = {}
REPLIES: dict[str, str] = {}
SYNC_STATE = {"min_id": COALESCE, "max_id": COALESCE}
SYNC_STATE_HISTORY = {c: COALESCE for c in ("pts", "qts", "date", "min_id", "max_id")}
SYNC_STATE_CHANNEL = SYNC_STATE | {"uncertain": "false"}
ACCOUNT_STATE: dict[str, str] = {}
BACKLOG = {"discovered_pts": GREATEST, "current_pts": COALESCE, "attempts": KEEP}
BACKLOG_CATCH_UP = BACKLOG | {"status": "if(b.status = 'completed', c.status, b.status)"}
BASELINE: dict[str, str] = {}
_BUSY = "b.download_status in ('completed', 'downloading')"
MEDIA = {
    "download_status": f"if({_BUSY}, b.download_status, c.download_status)", "verification_status": "if(b.download_status = 'completed', b.verification_status, c.verification_status)",
    "filter_decision": "if(b.download_status = 'completed', b.filter_decision, c.filter_decision)", "local_rel_path": FIRST, "sha256": FIRST, "mime_type": COALESCE, "size_bytes": COALESCE,
    "dc_id": "if(c.dc_id = 0, b.dc_id, c.dc_id)", "created_at": FIRST,
}


def merge_peers(base: DataFrame, changes: DataFrame, auxiliary: bool = False) -> DataFrame:
    return merge(base, changes, ["peer_id"], PEERS_AUXILIARY if auxiliary else PEERS)


def merge_media(base: DataFrame, changes: DataFrame) -> DataFrame:
    return merge(base, changes, ["media_id"], MEDIA)


def merge_backlog(base: DataFrame, changes: DataFrame, catch_up: bool = False) -> DataFrame:
    return merge(base, changes, ["peer_id"], BACKLOG_CATCH_UP if catch_up else BACKLOG)


def merge_sync_state(base: DataFrame, changes: DataFrame, variant: str = "common") -> DataFrame:
    rules = {"common": SYNC_STATE, "history": SYNC_STATE_HISTORY, "channel": SYNC_STATE_CHANNEL}[variant]
    return merge(base, changes, ["peer_id"], rules)


#: Columns whose change makes a revision. Views, counts, state, sender and date don't.
REVISED = ("text", "entities_json", "reply_to_msg_id", "reply_to_peer_id", "reply_to_top_id", "forward_json", "reactions_json")
#: Columns that make one when they change to a value.
REVISED_TO_VALUE = ("edit_date", "raw")


def derive_revisions(versions: DataFrame, order: str = "seq") -> DataFrame:
    """Every version that a later one of its message replaced with other content, numbered oldest first.

    versions: all versions of the messages, the stored one included, ordered by `order` within a key.
    """
    log = Window.partitionBy("peer_id", "message_id").orderBy(order)
    rows, changed = versions, F.lit(False)
    for c in (c for c in REVISED if c in versions.columns):
        changed = changed | ~F.lead(c).over(log).eqNullSafe(F.col(c))
    for c in (c for c in REVISED_TO_VALUE if c in versions.columns):
        changed = changed | (F.lead(c).over(log).isNotNull() & ~F.lead(c).over(log).eqNullSafe(F.col(c)))
    rows = rows.withColumn("_changed", F.lead(F.lit(1)).over(log).isNotNull() & changed).where("_changed").drop("_changed")
    return rows.withColumn("revision_no", F.row_number().over(log))


def merge_messages(base: DataFrame, versions: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(messages, revisions) after all versions in order, not only the last of each key."""
    stored = base.withColumn(order, F.lit(-1).cast("long"))
    revisions = derive_revisions(stored.unionByName(versions, allowMissingColumns=True), order)
    last = last_change(versions, ["peer_id", "message_id"], [order]).drop(order)
    return merge(base, last, ["peer_id", "message_id"], MESSAGES), revisions


def apply_channel_deletes(messages: DataFrame, deletes: DataFrame, now: int) -> DataFrame:
    """Mark deleted; a key that isn't there becomes a placeholder dated now."""
    gone = deletes.select("peer_id", "message_id").distinct().withColumn("_gone", F.lit(True))
    rows = messages.join(gone, ["peer_id", "message_id"], "full")
    fixed = {"state": F.when(F.col("_gone"), F.lit("deleted")).otherwise(F.col("state")), "date": F.coalesce("date", F.lit(now).cast("long"))}
    return rows.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in messages.columns))


def classify_common_deletes(messages: DataFrame, peers: DataFrame, deletes: DataFrame) -> DataFrame:
    """Deleted ids without a chat: one user or group has it (delete), several (ambiguous) or none (tombstone)."""
    ids = deletes.select("message_id").distinct()
    held = messages.join(ids, "message_id", "left_semi").join(peers.where("peer_type in ('user', 'group')").select("peer_id"), "peer_id", "left_semi")
    counted = held.groupBy("message_id").agg(F.count("*").alias("n"), F.min("peer_id").alias("peer_id"))
    rows = ids.join(counted, "message_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("message_id", "n", F.when(F.col("n") == 1, "delete").when(F.col("n") > 1, "ambiguous").otherwise("tombstone").alias("outcome"), F.when(F.col("n") == 1, F.col("peer_id")).alias("peer_id"))


def apply_common_deletes(messages: DataFrame, peers: DataFrame, deletes: DataFrame) -> DataFrame:
    return mark_deleted(messages, classify_common_deletes(messages, peers, deletes).where("outcome = 'delete'"))


def mark_deleted(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """The content stays."""
    gone = keys.select("peer_id", "message_id").distinct().withColumn("_gone", F.lit(True))
    rows = messages.join(gone, ["peer_id", "message_id"], "left")
    return rows.withColumn("state", F.when(F.col("_gone"), F.lit("deleted")).otherwise(F.col("state"))).select(*messages.columns)


def set_media_status(media: DataFrame, outcomes: DataFrame, now: int, most_retries: int = 5) -> DataFrame:
    """Apply download outcomes (media_id, outcome: completed, retry, failed, requeue; wait seconds).

    A retry waits longer each time, five times the given wait at most; when retries are used up the object fails for good.
    """
    rows = media.join(outcomes.select("media_id", "outcome", "wait"), "media_id", "left")
    retries = F.col("retry_count") + 1
    status = (
        F.when(F.col("outcome") == "completed", "completed").when(F.col("outcome") == "failed", "permanently_failed").when(F.col("outcome") == "requeue", "pending")
        .when((F.col("outcome") == "retry") & (retries >= most_retries), "permanently_failed").when(F.col("outcome") == "retry", "retry_wait").otherwise(F.col("download_status"))
    )
    again = (F.col("outcome") == "retry") & (retries < most_retries)
    fixed = {
        "download_status": status, "next_retry_at": F.when(again, F.lit(now) + F.col("wait") * F.least(retries, F.lit(5))).when(F.col("outcome").isNotNull(), F.lit(None)).otherwise(F.col("next_retry_at")).cast("long"),
        "retry_count": F.when(F.col("outcome") == "retry", retries).otherwise(F.col("retry_count")).cast("int"), "claimed_at": F.when(F.col("outcome").isNull(), F.col("claimed_at")),
    }
    return rows.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in media.columns))


def migrate_legacy_media(media: DataFrame, legacy: DataFrame) -> DataFrame:
    """Legacy rows (media_key, sha256, ...) as objects; one whose verified hash contradicts the object's gets an id of its own."""
    known = media.select("media_id", F.col("sha256").alias("known_sha256"), (F.col("verification_status") == "verified").alias("known_verified"))
    rows = legacy.withColumnRenamed("media_key", "media_id").join(known, "media_id", "left")
    conflict = F.col("known_verified") & F.col("verified") & (F.col("sha256") != F.col("known_sha256"))
    return rows.withColumn("media_id", F.when(conflict, F.concat("media_id", F.lit("_legacy_conflict"))).otherwise(F.col("media_id"))).drop("known_sha256", "known_verified").dropDuplicates(["media_id"])


def merge_dialog_lists(lists: DataFrame, excluded: DataFrame) -> DataFrame:
    """Dialogs of several lists (peer_id, list_no, position): the first occurrence wins, excluded ones go."""
    first = lists.groupBy("peer_id").agg(F.min(F.struct("list_no", "position")).alias("f")).select("peer_id", "f.list_no", "f.position")
    return first.join(excluded.select("peer_id"), "peer_id", "left_anti")


def stale_channels(local: DataFrame, server: DataFrame) -> DataFrame:
    """Channels to catch up with: no local pts (baseline), server ahead (pending), unresolved (blocked)."""
    rows = server.join(local.select("peer_id", F.col("pts").alias("local_pts")), "peer_id", "left")
    status = F.when(~F.col("resolved"), "blocked").when(F.col("local_pts").isNull(), "baseline").when(F.col("pts") > F.col("local_pts"), "pending")
    return rows.withColumn("status", status).where("status is not null").select("peer_id", "local_pts", "pts", "status")


def removed_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti")
