"""Integrity audits: each rule yields findings of one schema; reports are aggregations over their union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_finding, utf16_length
from . import graph, joins
from . import windows as win

SEVERITIES = ("fatal", "error", "warning", "info")
#: The categories of findings, in the order of reports.
CATEGORIES = (
    "schema", "referential_integrity", "identity", "chronology", "message_state", "reply_graph", "revision", "entity", "service_message", "media",
    "filesystem", "sync_state", "unsupported_update", "queue", "migration", "search", "html_export", "manifest", "security", "completeness",
)
#: The codes of each category and severity.
CODES = {
    ("schema", "fatal"): ("SCHEMA_VERSION_EMPTY", "REQUIRED_TABLE_MISSING"),
    ("schema", "error"): ("SCHEMA_VERSION_OUTDATED", "REQUIRED_COLUMN_MISSING"),
    ("referential_integrity", "error"): ("DB_FOREIGN_KEY_VIOLATION", "MESSAGE_WITHOUT_PEER_RECORD", "MESSAGE_MEDIA_ORPHAN_MESSAGE", "MESSAGE_MEDIA_ORPHAN_OBJECT"),
    ("identity", "error"): ("MESSAGE_ID_INVALID_RANGE", "PEER_ID_ZERO"),
    ("identity", "warning"): ("UNKNOWN_PEER_TYPE",),
    ("chronology", "error"): ("MESSAGE_DATE_IMPOSSIBLE",),
    ("chronology", "warning"): ("CHRONOLOGY_SEVERE_INVERSION",),
    ("message_state", "error"): ("MESSAGE_STATE_INVALID",),
    ("message_state", "warning"): ("EDITED_WITHOUT_REVISION_HISTORY",),
    ("message_state", "info"): ("MESSAGE_EMPTY_CONFLATION",),
    ("reply_graph", "error"): ("REPLY_SELF_REFERENCE", "REPLY_CYCLE_DETECTED"),
    ("reply_graph", "warning"): ("REPLY_TARGET_MISSING", "REPLY_TARGET_OUT_OF_SCOPE", "REPLY_CHAIN_DEPTH_EXCEEDED"),
    ("reply_graph", "info"): ("REPLY_TARGET_UNAVAILABLE",),
    ("revision", "error"): ("REVISION_ORDER_INVALID",),
    ("entity", "error"): ("ENTITIES_JSON_MALFORMED", "ENTITIES_NOT_ARRAY", "ENTITY_MISSING_BOUNDS", "ENTITY_NEGATIVE_BOUNDS", "ENTITY_UTF16_OUT_OF_BOUNDS"),
    ("service_message", "error"): ("TL_MALFORMED_BYTES",),
    ("media", "error"): ("MEDIA_VERIFICATION_FAILED", "COMPLETED_MEDIA_WITHOUT_PATH", "MEDIA_FILE_MISSING", "MEDIA_SIZE_MISMATCH", "MEDIA_HASH_MISMATCH", "MEDIA_READ_FAILED"),
    ("media", "warning"): ("MEDIA_UNVERIFIED", "MEDIA_STALE_CLAIM", "MEDIA_INVALID_CLAIM_STATE", "MEDIA_RETRY_WAIT_INVALID"),
    ("media", "info"): ("ORPHAN_MEDIA_FILE",),
    ("filesystem", "error"): ("PATH_CONTAINS_NULL_BYTE", "PATH_ABSOLUTE_ESCAPE", "PATH_WINDOWS_DRIVE_ESCAPE", "PATH_TRAVERSAL_ESCAPE"),
    ("filesystem", "warning"): ("ORPHAN_PART_FILE",),
    ("sync_state", "error"): ("SYNC_STATE_NEGATIVE_SEQUENCE",),
    ("sync_state", "warning"): ("PEER_SYNC_UNCERTAIN",),
    ("sync_state", "info"): ("SYNC_STATE_EMPTY",),
    ("unsupported_update", "warning"): ("UNSUPPORTED_STATE_AFFECTING_UPDATE",),
    ("unsupported_update", "info"): ("UNSUPPORTED_UPDATE_RECORDED",),
    ("queue", "warning"): ("QUEUE_CHANNEL_BLOCKED",),
    ("queue", "info"): ("QUEUE_CHANNEL_PENDING",),
    ("search", "error"): ("SEARCH_MANIFEST_UNREADABLE", "SEARCH_MANIFEST_MALFORMED_JSON", "SEARCH_DUPLICATE_SHARD_ID", "SEARCH_SHARD_MISSING", "SEARCH_SHARD_ENTRIES_MISMATCH", "SEARCH_SHARD_CORRUPTED_JSON", "SEARCH_PREFIX_INDEX_OUT_OF_BOUNDS"),
    ("search", "warning"): ("SEARCH_MANIFEST_MISSING", "SEARCH_UNDECLARED_SHARD"),
    ("html_export", "fatal"): ("HTML_EXPORT_DIR_MISSING",),
    ("html_export", "error"): ("HTML_MANIFEST_MISSING", "HTML_MANIFEST_CORRUPTED", "HTML_MANIFEST_EMPTY_SOURCE_FINGERPRINT", "HTML_MANIFEST_EMPTY_CONFIG_FINGERPRINT", "HTML_SOURCE_FINGERPRINT_MISMATCH", "HTML_INTEGRITY_VIOLATION"),
}
_KIND = {code: kind for kind, codes in CODES.items() for code in codes}
#: Dates a message can't have (before 2013-08-01 or from 2050 on).
FIRST_DATE, LAST_DATE = 1375315200, 2524608000
STATES = ("active", "edited", "deleted", "empty", "inaccessible")
PEER_TYPES = ("user", "group", "channel")
STALE_CLAIM = 3600


def findings(rows: DataFrame, *checks: tuple, peer: str | None = None, message: str | None = None) -> DataFrame:
    """What conditions find in one pass over rows: code, category, severity, peer_id, message_id, subject, detail.

    checks: (code, condition, subject, detail), the last two (columns) optional; a row can be found by several.
    """
    one = lambda c, to: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(to)
    found = []
    for code, condition, *rest in checks:
        subject, detail = (*rest, None, None)[:2]
        category, severity = _KIND[code]
        found.append(F.when(F.expr(condition) if isinstance(condition, str) else condition, F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), one(subject, "string").alias("subject"), one(detail, "string").alias("detail"))))
    hits = rows.select(one(peer, "long").alias("peer_id"), one(message, "long").alias("message_id"), F.explode(F.array_compact(F.array(*found))).alias("_f"))
    return hits.select("_f.code", "_f.category", "_f.severity", "peer_id", "message_id", "_f.subject", "_f.detail")


def finding(rows: DataFrame, code: str, peer: str | None = None, message: str | None = None, subject: str | Column | None = None, detail: str | Column | None = None) -> DataFrame:
    """All of rows as findings of one code."""
    return findings(rows, (code, F.lit(True), subject, detail), peer=peer, message=message)


@dataclass
class Tables:
    """What an audit may look at. Rules whose tables are missing are left out."""

    messages: DataFrame | None = None
    peers: DataFrame | None = None
    media: DataFrame | None = None
    links: DataFrame | None = None
    revisions: DataFrame | None = None
    files: DataFrame | None = None
    sync_state: DataFrame | None = None
    backlog: DataFrame | None = None
    events: DataFrame | None = None
    manifest: DataFrame | None = None
    shards: DataFrame | None = None
    prefixes: DataFrame | None = None
    export_manifest: DataFrame | None = None
    fingerprints: DataFrame | None = None
    violations: DataFrame | None = None
    manifest_text: DataFrame | None = None
    shard_text: DataFrame | None = None
    export_files: DataFrame | None = None
    now: int = 0


RULES: dict[str, tuple[tuple[str, ...], Callable[[Tables], list[DataFrame]]]] = {}


def rule(name: str, *needs: str):
    def put(f):
        RULES[name] = (needs, f)
        return f

    return put


def schema_findings(spark, declared: dict[str, list[str]], present: dict[str, list[str]], version: int | None, wanted_version: int) -> DataFrame:
    """Missing tables and columns, and an outdated or missing version. The catalog is small and fixed."""
    rows = []
    if version is None:
        rows.append(("SCHEMA_VERSION_EMPTY", None))
    elif version < wanted_version:
        rows.append(("SCHEMA_VERSION_OUTDATED", str(version)))
    for table, columns in declared.items():
        if table not in present:
            rows.append(("REQUIRED_TABLE_MISSING", table))
        else:
            rows += [("REQUIRED_COLUMN_MISSING", f"{table}.{c}") for c in columns if c not in present[table]]
    found = spark.createDataFrame([(code, *_KIND[code], subject) for code, subject in rows], "code string, category string, severity string, subject string")
    empty = F.lit(None)
    return found.select("code", "category", "severity", empty.cast("long").alias("peer_id"), empty.cast("long").alias("message_id"), "subject", empty.cast("string").alias("detail"))


@rule("references", "messages", "peers")
def _(t):
    return [finding(joins.messages_without_peer(t.messages, t.peers), "MESSAGE_WITHOUT_PEER_RECORD", "peer_id")]


@rule("media_references", "links", "messages", "media")
def _(t):
    rows = joins.orphan_media_links(t.links, t.messages, t.media)
    return [findings(rows, *((f"MESSAGE_MEDIA_ORPHAN_{r.upper()}", f"reason = '{r}'", "media_id") for r in ("message", "object")), peer="peer_id", message="message_id")]


@rule("foreign_keys", "violations")
def _(t):
    """violations: the counts of joins.foreign_key_violations, one finding a child and key that has some."""
    return [findings(t.violations, ("DB_FOREIGN_KEY_VIOLATION", "n_violations > 0", F.concat_ws(".", "child", "key"), "n_violations"))]


@rule("identity", "messages", "peers")
def _(t):
    return [
        findings(t.messages, ("MESSAGE_ID_INVALID_RANGE", "message_id <= 0 or message_id > 2147483647"), peer="peer_id", message="message_id"),
        findings(t.peers, ("PEER_ID_ZERO", "peer_id = 0"), ("UNKNOWN_PEER_TYPE", ~F.coalesce(F.col("peer_type"), F.lit("")).isin(*PEER_TYPES), "peer_type"), peer="peer_id"),
    ]


@rule("chronology", "messages", "peers")
def _(t):
    return [
        findings(t.messages, ("MESSAGE_DATE_IMPOSSIBLE", (F.col("date") < FIRST_DATE) | (F.col("date") > LAST_DATE), None, "date"), peer="peer_id", message="message_id"),
        finding(joins.chronology_inversions(t.messages, t.peers), "CHRONOLOGY_SEVERE_INVERSION", "peer_id", "message_id", detail="earlier_id"),
    ]


@rule("state", "messages")
def _(t):
    return [findings(t.messages, ("MESSAGE_STATE_INVALID", ~F.coalesce(F.col("state"), F.lit("")).isin(*STATES), "state"), ("MESSAGE_EMPTY_CONFLATION", "state = 'empty' and text <> ''"), peer="peer_id", message="message_id")]


@rule("edits", "messages", "revisions")
def _(t):
    return [finding(joins.edited_without_revision(t.messages, t.revisions), "EDITED_WITHOUT_REVISION_HISTORY", "peer_id", "message_id")]


@rule("revisions", "revisions")
def _(t):
    return [finding(win.revision_order_check(t.revisions), "REVISION_ORDER_INVALID", "peer_id", "message_id", detail="revision_no")]


def entity_bounds(messages: DataFrame) -> DataFrame:
    """(keys, text, entity no, offset, length) of entities_json; bounds stand at the top or one level down."""
    rows = messages.where("entities_json is not null").withColumn("_v", F.try_parse_json("entities_json"))
    rows = rows.withColumn("_is_array", F.schema_of_variant("_v").startswith("ARRAY"))
    items = F.from_json("entities_json", "array<string>")
    parsed = rows.withColumn("_items", F.when(F.col("_is_array"), items))
    one = parsed.select("peer_id", "message_id", "text", F.posexplode("_items").alias("entity_no", "_e"))
    inner = F.regexp_extract("_e", r'^\s*\{\s*"[^"]*"\s*:\s*(\{.*\})\s*\}\s*$', 1)
    bound = lambda n: F.coalesce(F.get_json_object("_e", f"$.{n}"), F.get_json_object(inner, f"$.{n}")).cast("long")
    return one.select("peer_id", "message_id", "text", "entity_no", bound("offset").alias("offset"), bound("length").alias("length"))


@rule("entities", "messages")
def _(t):
    if "entities_json" not in t.messages.columns:
        return []
    parsed = F.try_parse_json("entities_json")
    offset, length = F.col("offset"), F.col("length")
    beyond = (offset >= 0) & (length >= 0) & (offset + length > F.coalesce(utf16_length("text"), F.lit(0)))
    return [
        findings(t.messages.where("entities_json is not null"), ("ENTITIES_JSON_MALFORMED", parsed.isNull()), ("ENTITIES_NOT_ARRAY", ~F.schema_of_variant(parsed).startswith("ARRAY")), peer="peer_id", message="message_id"),
        findings(entity_bounds(t.messages), ("ENTITY_MISSING_BOUNDS", "offset is null or length is null", "entity_no"), ("ENTITY_NEGATIVE_BOUNDS", "offset < 0 or length < 0", "entity_no"), ("ENTITY_UTF16_OUT_OF_BOUNDS", beyond, "entity_no"), peer="peer_id", message="message_id"),
    ]


@rule("payload", "messages")
def _(t):
    if "raw" not in t.messages.columns:
        return []
    return [findings(t.messages, ("TL_MALFORMED_BYTES", "octet_length(raw) < 4"), peer="peer_id", message="message_id")]


@rule("sync_state", "sync_state")
def _(t):
    empty = t.sync_state.agg(F.count("*").alias("n")).where("n = 0")
    return [findings(t.sync_state, ("PEER_SYNC_UNCERTAIN", "uncertain"), ("SYNC_STATE_NEGATIVE_SEQUENCE", "pts < 0", None, "pts"), peer="peer_id"), finding(empty, "SYNC_STATE_EMPTY")]


@rule("events", "events")
def _(t):
    return [findings(t.events, ("UNSUPPORTED_STATE_AFFECTING_UPDATE", "affects_state", "event_id"), ("UNSUPPORTED_UPDATE_RECORDED", "not affects_state", "event_id"), peer="peer_id")]


@rule("backlog", "backlog")
def _(t):
    return [findings(t.backlog, ("QUEUE_CHANNEL_BLOCKED", "status in ('blocked', 'failed')", "status"), ("QUEUE_CHANNEL_PENDING", "status = 'pending'", "status"), peer="peer_id")]


@rule("media", "media")
def _(t):
    skipped = F.coalesce(F.col("filter_decision"), F.lit("")).isin("skip", "skipped") if "filter_decision" in t.media.columns else F.lit(False)
    done = (F.col("download_status") == "completed") & ~skipped
    return [findings(
        t.media, ("MEDIA_UNVERIFIED", done & F.expr("verification_status = 'unverified'"), "media_id"), ("MEDIA_VERIFICATION_FAILED", done & F.expr("verification_status not in ('unverified', 'verified')"), "media_id", "verification_status"),
        ("COMPLETED_MEDIA_WITHOUT_PATH", done & F.col("local_rel_path").isNull(), "media_id"), ("MEDIA_STALE_CLAIM", (F.col("download_status") == "downloading") & (F.col("claimed_at") < t.now - STALE_CLAIM), "media_id"),
        ("MEDIA_INVALID_CLAIM_STATE", "(download_status = 'downloading') <> (claimed_at is not null)", "media_id"), ("MEDIA_RETRY_WAIT_INVALID", "download_status = 'retry_wait' and next_retry_at is null", "media_id"))]


#: The codes of what a file and its record can be.
FILE_CODES = {"missing": "MEDIA_FILE_MISSING", "size_mismatch": "MEDIA_SIZE_MISMATCH", "unreadable": "MEDIA_READ_FAILED", "hash_mismatch": "MEDIA_HASH_MISMATCH", "orphan_part": "ORPHAN_PART_FILE", "orphan_file": "ORPHAN_MEDIA_FILE"}


@rule("media_files", "media", "files")
def _(t):
    return [findings(joins.match_files(t.files, t.media), *((code, F.col("result") == result, F.coalesce("media_id", "rel_path")) for result, code in FILE_CODES.items()))]


@rule("paths", "media")
def _(t):
    rows = t.media.where("local_rel_path is not null").select("media_id", path_finding("local_rel_path").alias("_code"))
    return [findings(rows, *((code, F.col("_code") == code, "media_id") for code in CODES["filesystem", "error"]))]


@rule("replies", "messages", "peers")
def _(t):
    rows = joins.resolve_replies(t.messages, t.peers).where("not (peer_id = target_peer_id and message_id = target_message_id)")
    to = "target_message_id"
    return [
        finding(graph.self_replies(t.messages), "REPLY_SELF_REFERENCE", "peer_id", "message_id"),
        findings(rows, ("REPLY_TARGET_UNAVAILABLE", "target_state in ('deleted', 'inaccessible')", to), ("REPLY_TARGET_MISSING", "target_state is null and peer_known", to), ("REPLY_TARGET_OUT_OF_SCOPE", "target_state is null and not peer_known", to), peer="peer_id", message="message_id"),
    ]


def reply_walk_findings(messages: DataFrame, deep: int = 1000, most_hops: int = 1024) -> DataFrame:
    """Cycles and chains that are too deep; apart from the other rules because it runs jobs of its own."""
    found = graph.walks(messages, most_hops)
    cycles = finding(graph.reply_cycles(found, messages, most_hops), "REPLY_CYCLE_DETECTED", "peer_id", "message_id", "n_members")
    return cycles.unionByName(finding(graph.deep_chains(found, deep, most_hops), "REPLY_CHAIN_DEPTH_EXCEEDED", "peer_id", "message_id", "depth"))


@rule("search_index", "manifest", "shards", "prefixes")
def _(t):
    """manifest (shard_id, n_entries), shards (shard_id of each entry), prefixes (prefix, shard_id)."""
    there = t.shards.groupBy("shard_id").agg(F.count("*").alias("found"))
    rows = t.manifest.groupBy("shard_id").agg(F.count("*").alias("declared"), F.max("n_entries").alias("n_entries")).join(there, "shard_id", "full")
    lost = t.prefixes.select("shard_id").distinct().join(t.manifest, "shard_id", "left_anti")
    return [
        findings(rows, ("SEARCH_DUPLICATE_SHARD_ID", "declared > 1", "shard_id"), ("SEARCH_SHARD_MISSING", "found is null", "shard_id"), ("SEARCH_UNDECLARED_SHARD", "declared is null", "shard_id"), ("SEARCH_SHARD_ENTRIES_MISMATCH", "found <> n_entries", "shard_id", "found")),
        finding(lost, "SEARCH_PREFIX_INDEX_OUT_OF_BOUNDS", subject="shard_id"),
    ]


def _bad_json(text: str) -> Column:
    return F.try_parse_json(text).isNull()


@rule("search_manifest", "manifest_text")
def _(t):
    """manifest_text (path, text): an index's manifest as it was written, as JSON; one that can't be read has a null text, and no row means that there is none."""
    none = t.manifest_text.agg(F.count("*").alias("n")).where("n = 0")
    return [findings(t.manifest_text, ("SEARCH_MANIFEST_UNREADABLE", "text is null", "path"), ("SEARCH_MANIFEST_MALFORMED_JSON", F.col("text").isNotNull() & _bad_json("text"), "path")), finding(none, "SEARCH_MANIFEST_MISSING")]


@rule("search_shards", "shard_text")
def _(t):
    """shard_text (path, text): lines of shards that are kept as JSON. A shard with bad lines is one finding, which counts them."""
    bad = t.shard_text.where(F.col("text").isNull() | _bad_json("text")).groupBy("path").agg(F.count("*").alias("n"))
    return [finding(bad, "SEARCH_SHARD_CORRUPTED_JSON", subject="path", detail="n")]


@rule("export_files", "export_files")
def _(t):
    """export_files (folder, exists, manifest): one row an export folder that is looked for, with the manifest's text, null if there is none."""
    here, text = F.coalesce("exists", F.lit(False)), F.col("manifest")
    return [findings(t.export_files, ("HTML_EXPORT_DIR_MISSING", ~here, "folder"), ("HTML_MANIFEST_MISSING", here & text.isNull(), "folder"), ("HTML_MANIFEST_CORRUPTED", here & text.isNotNull() & _bad_json("manifest"), "folder"))]


@rule("export", "export_manifest", "fingerprints")
def _(t):
    """export_manifest (peer_id, source_fingerprint, config_fingerprint) against the chats' current fingerprints."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = t.export_manifest.join(t.fingerprints.select("peer_id", F.col("fingerprint").alias("_now")), "peer_id", "left")
    return [findings(
        rows, ("HTML_MANIFEST_EMPTY_SOURCE_FINGERPRINT", blank("source_fingerprint")), ("HTML_MANIFEST_EMPTY_CONFIG_FINGERPRINT", blank("config_fingerprint")),
        ("HTML_SOURCE_FINGERPRINT_MISMATCH", ~F.coalesce("source_fingerprint", F.lit("")).eqNullSafe(F.col("_now"))), peer="peer_id")]


def bundle_findings(anchors: DataFrame, broken: DataFrame, counts: DataFrame) -> DataFrame:
    """HTML_INTEGRITY_VIOLATION for each duplicate anchor, broken link and chat whose pages aren't those of its manifest.

    They are the rows of links.duplicate_anchors, links.broken_links and links.bundle_counts.
    """
    code = "HTML_INTEGRITY_VIOLATION"
    found = finding(anchors, code, subject=F.coalesce("page", F.lit("export")), detail=F.concat(F.lit("anchor "), "anchor"))
    found = found.unionByName(finding(broken, code, subject=broken.columns[0], detail=F.concat(F.lit("link "), "href")))
    return found.unionByName(finding(counts, code, "peer_id", detail=F.concat(F.lit("pages "), F.col("found").cast("string"))))


def audit(tables: Tables, scopes: tuple[str, ...] | None = None, fast: bool = False) -> DataFrame:
    """All findings of the rules whose tables are given. fast leaves out what reads files and walks."""
    found = None
    for name, (needs, build) in RULES.items():
        if (scopes is not None and name not in scopes) or (fast and name == "media_files") or any(getattr(tables, n) is None for n in needs):
            continue
        for part in build(tables):
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no rule applies to the given tables")
    return found


def sort_findings(findings: DataFrame) -> DataFrame:
    """The worst first, then by category, place, code and detail; nulls first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    kind = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return findings.orderBy(rank, kind, *(F.asc_nulls_first(c) for c in ("peer_id", "message_id", "subject", "code", "detail")))


def finding_counts(findings: DataFrame) -> DataFrame:
    """A row for each category and severity, zero where there is nothing."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(c, s) for c in CATEGORIES for s in SEVERITIES], "category string, severity string")
    counts = findings.groupBy("category", "severity").agg(F.count("*").alias("n"))
    return every.join(counts, ["category", "severity"], "left").select("category", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def overall_status(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: fatal, errors, warnings or passed, and the exit code 3 to 0; strict exits for warnings as for errors."""
    n = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    status = F.when(F.col("fatal") > 0, "fatal").when(F.col("error") > 0, "errors").when(F.col("warning") > 0, "warnings").otherwise("passed")
    code = F.when(F.col("fatal") > 0, 3).when(F.col("error") > 0, 2).when(F.col("warning") > 0, 2 if strict else 1).otherwise(0)
    return n.select(status.alias("status"), code.alias("exit_code"))


#: For each action its kind, its risk and the codes that call for it.
ACTIONS = {
    "CLEANUP_ORPHAN_PART_FILES": ("safe_automation", "None", ("ORPHAN_PART_FILE",)),
    "REBUILD_SEARCH_INDEX": ("manual_review", "Low", ("SEARCH_SHARD_MISSING", "SEARCH_SHARD_COUNT_MISMATCH", "SEARCH_PREFIX_BROKEN")),
    "RE_EXPORT_HTML": ("manual_review", "Low", ("HTML_SOURCE_FINGERPRINT_MISMATCH", "HTML_PAGE_MISSING", "HTML_LINK_BROKEN")),
    "REVIEW_ORPHAN_MEDIA_FILES": ("manual_review", "Medium", ("ORPHAN_MEDIA_FILE",)),
    "REDOWNLOAD_MISSING_MEDIA": ("requires_resync", "Medium", ("MEDIA_FILE_MISSING", "MEDIA_HASH_MISMATCH", "MEDIA_CORRUPTED_SIZE")),
    "RESYNC_UNCERTAIN_UPDATES": ("requires_resync", "Low", ("SYNC_UNCERTAIN", "UNSUPPORTED_STATE_AFFECTING_UPDATE")),
    "RESOLVE_BLOCKED_CHANNELS": ("requires_resync", "Medium", ("QUEUE_CHANNEL_BLOCKED",)),
}


def repair_items(findings: DataFrame) -> DataFrame:
    """The findings that something can be done about, each with action, kind and risk."""
    spark = findings.sparkSession
    actions = spark.createDataFrame([(code, action, kind, risk) for action, (kind, risk, codes) in ACTIONS.items() for code in codes], "code string, action string, kind string, risk string")
    return findings.join(F.broadcast(actions), "code")  # a fixed table


def repair_plan(findings: DataFrame) -> DataFrame:
    """Recommendations: action, kind, risk, how much it concerns and by which codes. An outdated export alone counts as one.

    The things themselves stay rows of repair_items: lists of them would grow with the archive.
    """
    n = F.when(F.col("action") == "RE_EXPORT_HTML", F.greatest(F.lit(1), F.count_if(F.col("code") != "HTML_SOURCE_FINGERPRINT_MISMATCH"))).otherwise(F.count("*"))
    return repair_items(findings).groupBy("action", "kind", "risk").agg(n.alias("n_affected"), F.array_sort(F.collect_set("code")).alias("codes"))


#: What a sync report says about its run; columns that it lacks count as false or 0.
PROVENANCE = {"provenance_version": 0, "deletions_performed": False, "deletions_complete": False, "deletion_gaps": 0, "messages_performed": False, "messages_complete": False, "message_gaps": 0, "channels_complete": False, "event_window_lost": False}


def media_metrics(media: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for completeness: records, those verified on disk, and the files that are missing or differ. matches: joins.match_files."""
    total = media.agg(F.count("*").alias("n_media"))
    bad = matches.agg(F.count_if(F.col("result") == "match").alias("n_verified"), F.count_if(F.col("result").isin("missing", "size_mismatch", "hash_mismatch")).alias("n_bad"))
    return total.crossJoin(bad)  # one row each


def completeness(findings: DataFrame, provenance: DataFrame | None = None, media: DataFrame | None = None, export: bool = False, indexed: bool = True, fast: bool = False) -> DataFrame:
    """Seven dimensions: status, reason, n_affected, evidence.

    provenance: the last sync report, one row or none, with columns of PROVENANCE; media: media_metrics, if files were
    looked at; export: whether an export (indexed: with a search index) was looked at.
    """
    code, category, severity = F.col("code"), F.col("category"), F.col("severity")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    html, search, bad = category.isin("html_export", "manifest"), category == "search", severity.isin("error", "fatal")
    old = code == "HTML_SOURCE_FINGERPRINT_MISMATCH"
    row = findings.agg(
        some(code.isin("SYNC_UNCERTAIN", "PEER_SYNC_UNCERTAIN")).alias("uncertain"), some(code == "UNSUPPORTED_STATE_AFFECTING_UPDATE").alias("unsupported"), some(code == "QUEUE_CHANNEL_BLOCKED").alias("blocked"), some(code == "MESSAGE_WITHOUT_PEER_RECORD").alias("peerless"),
        some(old).alias("html_old"), some(html & bad & ~old).alias("html_bad"), some(html & (severity == "warning")).alias("html_warned"), some(search & bad).alias("search_bad"), some(search & (severity == "warning")).alias("search_warned"),
        F.count_if(code.isin("MEDIA_UNVERIFIED", "MEDIA_VERIFICATION_FAILED")).alias("n_unverified"),
    )
    if provenance is None:
        row = row.select("*", F.lit(False).alias("reported"), *(F.lit(v).alias(c) for c, v in PROVENANCE.items()))
    else:
        said = provenance.agg((F.count("*") > 0).alias("reported"), *((F.coalesce(F.max(c), F.lit(v)) if c in provenance.columns else F.lit(v)).alias(c) for c, v in PROVENANCE.items()))
        row = row.crossJoin(said)  # one row each
    if media is not None:
        row = row.crossJoin(media)
    col, no = F.col, F.array().cast("array<string>")

    def dim(status, reason: str, n=0, *evidence: str) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.struct(status.alias("status"), F.lit(reason).alias("reason"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n_affected"), (F.array(*map(F.lit, evidence)) if evidence else no).alias("evidence"))

    known = col("provenance_version") >= 2
    told = {d: known & col(f"{d}s_performed") for d in ("message", "deletion")}
    whole = {d: told[d] & col(f"{d}s_complete") & (col(f"{d}_gaps") == 0) for d in told}
    torn = {d: told[d] & (~col(f"{d}s_complete") | (col(f"{d}_gaps") > 0)) for d in told}
    lost = col("event_window_lost")
    no_proof = "no report proves it"
    history = (
        F.when(col("uncertain") | col("unsupported"), dim("uncertain", "a gap or an unsupported event is open", 1, "SYNC_UNCERTAIN")).when(col("peerless"), dim("incomplete", "messages of unknown chats", 1, "MESSAGE_WITHOUT_PEER_RECORD"))
        .when(whole["message"], dim("complete", "reconciled without gaps")).when(torn["message"], dim("incomplete", "gaps were not closed", 1, "MESSAGE_HISTORY_GAP_DETECTED")).otherwise(dim("uncertain", no_proof))
    )
    deletions = (
        F.when(col("uncertain"), dim("uncertain", "the feed has gaps", 1, "SYNC_UNCERTAIN")).when(whole["deletion"] & ~lost, dim("complete", "reconciled without gaps"))
        .when(torn["deletion"] | lost, dim("incomplete", "events were lost or gaps were not closed", 1, "DELETION_RECONCILIATION_INCOMPLETE")).otherwise(dim("uncertain", no_proof))
    )
    skipped = dim("not_applicable", "left out in fast mode")
    channels = skipped if fast else (
        F.when(col("blocked"), dim("incomplete", "a channel is blocked", 1, "QUEUE_CHANNEL_BLOCKED")).when(col("reported") & col("channels_complete"), dim("complete", "every channel has its baseline"))
        .when(col("reported"), dim("incomplete", "the last run ended without all channels", 1, "CHANNEL_DISCOVERY_INCOMPLETE")).otherwise(dim("uncertain", no_proof))
    )
    sync = skipped if fast else F.when(col("uncertain") | col("unsupported"), dim("uncertain", "a chat or the account is uncertain", 1, "SYNC_UNCERTAIN")).otherwise(dim("clean", "nothing is uncertain"))
    binaries = dim("not_applicable", "files were not looked at")
    if media is not None:
        faults = col("n_bad") + col("n_unverified")
        share = F.format_string("%.1f%%", 100 * col("n_verified") / F.greatest(col("n_media"), F.lit(1)))
        binaries = F.when(col("n_media") == 0, dim("complete", "there is no media")).when(faults > 0, dim(share, "files are missing, unverified or damaged", faults, "MEDIA_FILE_MISSING")).otherwise(dim("100.0%", "every file is verified"))
    pages = index = dim("not_applicable", "there is no export")
    if export:
        pages = (
            F.when(col("html_old"), dim("mismatched", "the archive has changed since", 1, "HTML_SOURCE_FINGERPRINT_MISMATCH")).when(col("html_bad"), dim("corrupted", "pages or manifest are damaged", 1, "HTML_INTEGRITY_VIOLATION"))
            .when(col("html_warned"), dim("incomplete", "pages or manifest have warnings", 1, "HTML_EXPORT_WARNING")).otherwise(dim("consistent", "pages and manifest agree with the archive"))
        )
        fine = dim("complete", "every declared shard is there") if indexed else dim("not_applicable", "the export has no index")
        index = F.when(col("search_bad"), dim("corrupted", "manifest or shards are missing or damaged", 1, "SEARCH_SHARD_MISSING")).when(col("search_warned"), dim("incomplete", "shards that nothing declares", 1, "SEARCH_UNDECLARED_SHARD")).otherwise(fine)
    every = {"message_history": history, "deletion_verification": deletions, "channel_discovery": channels, "sync_uncertainty": sync, "media_binaries": binaries, "html_export": pages, "search_index": index}
    return row.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), c.alias("of")) for d, c in every.items()))).alias("d")).select("d.dimension", "d.of.*")
