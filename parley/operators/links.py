"""Link audit over exported pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_unescape

#: Links that lead out of an export on purpose.
EXTERNAL = ("http:", "https:", "mailto:", "tel:", "tg:", "ftp:", "data:", "javascript:")


def _all(html: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))


def extract_anchors(pages: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """(page, anchor) of every id attribute, repeated ones too."""
    return pages.select(page, F.explode(_all(html, ' id="([^"]*)"')).alias("anchor"))


def extract_links(pages: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """(page, href) of every link but `#`."""
    return pages.select(page, F.explode(_all(html, ' href="([^"]*)"')).alias("href")).where("href <> '#'")


def extract_media_refs(pages: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    return pages.select(page, F.explode(_all(html, ' src="([^"]*)"')).alias("src")).where(F.contains("src", F.lit("media/")))


def duplicate_anchors(anchors: DataFrame, page: str = "page") -> DataFrame:
    """Anchors twice on a page, and message anchors on several pages."""
    within = anchors.groupBy(page, "anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor"), F.col(page).cast("string").alias("page"), "n", F.lit("page").alias("scope"))
    across = anchors.where(F.col("anchor").startswith("msg-")).groupBy("anchor").agg(F.countDistinct(page).alias("n")).where("n > 1").select("anchor", F.lit(None).cast("string").alias("page"), "n", F.lit("export").alias("scope"))
    return within.unionByName(across)


def normalized(base: Column, path: Column) -> Column:
    """The path that a link on page `base` means, with `.` and `..` resolved; null if it leaves the root."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.concat(folder, path), "/")
    start = F.array().cast("array<string>")
    # a leading `..` stays visible as an element of its own and marks the escape
    walked = F.aggregate(parts, start, lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(F.lit(".."))))).otherwise(F.concat(acc, F.array(p))))
    return F.when(~F.array_contains(walked, ".."), F.array_join(walked, "/"))


def broken_links(links: DataFrame, pages: DataFrame, anchors: DataFrame, page: str = "page") -> DataFrame:
    """Internal links whose target page or anchor is missing, that leave the root, or hold bad characters."""
    href = F.trim(html_unescape("href"))
    rows = links.withColumn("_href", href).where(~F.exists(F.array(*map(F.lit, EXTERNAL)), lambda s: F.startswith(F.lower(F.col("_href")), s)) & ~F.startswith("_href", F.lit("//")))
    target, anchor = F.regexp_extract("_href", "^([^#?]*)", 1), F.regexp_extract("_href", "#(.*)$", 1)
    own = F.col(page).cast("string")
    rows = rows.select(page, "href", F.when(target == "", own).otherwise(normalized(own, target)).alias("target"), anchor.alias("anchor"), F.col("_href").rlike(r"[\x00-\x1f\\]").alias("bad"))
    known = pages.select(F.col(page).cast("string").alias("target"), F.lit(True).alias("_page")).distinct()
    named = anchors.select(F.col(page).cast("string").alias("target"), "anchor", F.lit(True).alias("_anchor")).distinct()
    rows = rows.join(known, "target", "left").join(named, ["target", "anchor"], "left")
    reason = F.when(F.col("bad"), "bad_characters").when(F.col("target").isNull(), "escapes_root").when(F.col("_page").isNull(), "missing_page").when((F.col("anchor") != "") & F.col("_anchor").isNull(), "missing_anchor")
    return rows.withColumn("reason", reason).where("reason is not null").select(page, "href", "target", "reason")


def bundle_counts(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chats whose number of pages isn't the manifest's (peer_id, n_pages)."""
    found = pages.groupBy("peer_id").agg(F.count("*").alias("found"))
    rows = manifest.join(found, "peer_id", "full")
    return rows.where("found is null or n_pages is null or found <> n_pages").select("peer_id", "n_pages", "found")
