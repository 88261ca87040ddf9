"""Media policy, reconciliation, deduplication and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import match_files


def media_policy(policy: dict) -> tuple[Column, Column]:
    """(decision, reason): the first rule that speaks wins. Keys: kinds, most_bytes, blocked_mimes, blocked_extensions, blocked_peers."""
    rules = [
        (F.col("peer_id").isin(policy["blocked_peers"]) if policy.get("blocked_peers") else None, "peer"),
        (~F.col("kind").isin(*policy["kinds"]) if policy.get("kinds") else None, "kind"),
        (F.col("size_bytes") > policy["most_bytes"] if policy.get("most_bytes") else None, "size"),
        (F.col("mime_type").isin(*policy["blocked_mimes"]) if policy.get("blocked_mimes") else None, "mime"),
        (F.lower(F.regexp_extract("local_rel_path", r"\.([^./]+)$", 1)).isin(*policy["blocked_extensions"]) if policy.get("blocked_extensions") else None, "extension"),
    ]
    reason = F.lit(None).cast("string")
    for condition, name in reversed([r for r in rules if r[0] is not None]):
        reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return F.when(reason.isNull(), "download").otherwise("skip"), reason


def apply_policy(media: DataFrame, policy: dict, version: int) -> DataFrame:
    """Skipped objects that pass become pending, pending ones that don't become skipped; both get the version."""
    decision, reason = media_policy(policy)
    rows = media.withColumns({"_d": decision, "_r": reason})
    status = F.when((F.col("download_status") == "skipped") & (F.col("_d") == "download"), "pending").when((F.col("download_status") == "pending") & (F.col("_d") == "skip"), "skipped").otherwise(F.col("download_status"))
    return rows.withColumns({"download_status": status, "filter_decision": F.col("_d"), "filter_reason": F.col("_r"), "policy_version": F.lit(version)}).drop("_d", "_r")


def media_availability(media: DataFrame) -> DataFrame:
    """Whether an object can be shown, and why not."""
    reason = F.when(F.col("download_status") == "skipped", "skipped").when(F.col("download_status") == "permanently_failed", "failed").when(F.col("download_status") != "completed", "not_downloaded").when(F.col("verification_status") == "missing_file", "missing").when(F.col("verification_status").startswith("corrupted"), "corrupted")
    return media.select("media_id", reason.isNull().alias("available"), reason.alias("reason"))


def reconcile_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """New statuses of interrupted and completed objects, from the files that are there."""
    found = match_files(files, media.where("local_rel_path is not null").withColumn("download_status", F.lit("completed"))).where("media_id is not null").select("media_id", "result")
    rows = media.where("download_status in ('downloading', 'completed')").join(found, "media_id", "left")
    ok = F.col("result") == "match"
    status = F.when(F.coalesce(ok, F.lit(False)), "completed").when(F.col("download_status") == "downloading", "pending").when(F.coalesce("result", F.lit("missing")) == "missing", "pending").otherwise("completed")
    checked = F.when(ok, "verified").when(F.col("result") == "size_mismatch", "corrupted_size").when(F.col("result") == "hash_mismatch", "corrupted_hash").otherwise("missing_file")
    return rows.select("media_id", status.alias("download_status"), checked.alias("verification_status"))


def verify_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """Each completed object with a path: verified, missing, size or hash."""
    rows = match_files(files, media).where("media_id is not null")
    word = F.when(F.col("result") == "match", "verified").when(F.col("result") == "size_mismatch", "size").when(F.col("result") == "hash_mismatch", "hash").otherwise("missing")
    return rows.select("media_id", word.alias("outcome"))


def dedupe_media(media: DataFrame) -> DataFrame:
    """Each completed object and the one that stands for its content: the first with that hash."""
    kept = media.where("download_status = 'completed'").groupBy("sha256").agg(F.min("media_id").alias("kept_id"))
    return media.where("download_status = 'completed'").join(kept, "sha256").select("media_id", "kept_id")


def chunk_plan(media: DataFrame, chunk: int = 1 << 20, unit: int = 1 << 10) -> DataFrame:
    """Byte ranges of each object that never cross a chunk's edge; the last one is rounded up to the unit."""
    rows = media.where("size_bytes > 0").select("media_id", "size_bytes", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(chunk).cast("long"))).alias("chunk_no", "offset"))
    left = F.col("size_bytes") - F.col("offset")
    return rows.select("media_id", "chunk_no", "offset", F.least(F.lit(chunk).cast("long"), F.ceil(left / unit) * unit).alias("limit"))


def plan_media(described: DataFrame, policy: dict) -> tuple[DataFrame, DataFrame]:
    """(objects, links) of messages with a nested media array (media_id, kind, mime_type, size_bytes, role)."""
    one = described.select("peer_id", "message_id", F.posexplode("media").alias("position", "m")).select("peer_id", "message_id", "position", "m.*").withColumn("local_rel_path", F.lit(None).cast("string"))
    decision, reason = media_policy(policy)
    objects = one.withColumns({"filter_decision": decision, "filter_reason": reason}).groupBy("media_id").agg(*(F.min(c).alias(c) for c in ("kind", "mime_type", "size_bytes", "filter_decision", "filter_reason")))
    objects = objects.withColumn("download_status", F.when(F.col("filter_decision") == "skip", "skipped").otherwise("pending"))
    return objects, one.groupBy("peer_id", "message_id", "media_id", "role").agg(F.min("position").alias("position"))


def copy_manifest(links: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """Files that an export of each chat needs and that are there."""
    wanted = links.join(media.where("local_rel_path is not null").select("media_id", "local_rel_path"), "media_id").select("peer_id", F.col("local_rel_path").alias("rel_path")).distinct()
    return wanted.join(files.select("rel_path", "length"), "rel_path")


def retry_next(outcomes: DataFrame, now: int, most: int = 5) -> DataFrame:
    """(media_id, error_class, retry_count, wait) to the next status and time."""
    again = F.col("error_class").isin("flood_wait", "timeout", "network", "reference_expired")
    status = F.when(~again, "permanently_failed").when(F.col("retry_count") + 1 >= most, "permanently_failed").otherwise("retry_wait")
    return outcomes.select("media_id", status.alias("download_status"), F.when(status == "retry_wait", F.lit(now) + F.col("wait") * F.least(F.col("retry_count") + 1, F.lit(5))).cast("long").alias("next_retry_at"))
