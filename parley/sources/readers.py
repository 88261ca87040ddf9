"""Readers: archives, chat exports, file inventories, pages, feeds and search indexes."""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import staged
from ..operators.windows import carried
from .exports import split_export
from .schemas import ARCHIVE, EXPORT, UPDATES


def read_archive(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the archive's current version, with its declared schema. folder/CURRENT names the version."""
    version = spark.read.text(f"{folder}/CURRENT").first()[0].strip()
    return spark.read.schema(ARCHIVE[table]).parquet(f"{folder}/{version}/{table}")


def read_update_feed(spark: SparkSession, path: str, stream: bool = False, form: str = "json") -> DataFrame:
    """Update events, as a batch or a stream."""
    return (spark.readStream if stream else spark.read).schema(UPDATES).format(form).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, html) of every HTML file below a folder; page is the path within it."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path)
    return rows.select(_relative(F.input_file_name(), path).alias("page"), F.col("value").alias("html"))


def _relative(file: Column, root: str) -> Column:
    tail = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), f"^.*{re.escape(tail)}/", "")


def scan_media_files(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """File inventory: rel_path, length, sha256, is_part. folders: those below path that count, if not all do."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path if folders is None else folders)
    rel = _relative(F.col("path"), path)
    return rows.select(rel.alias("rel_path"), "length", F.sha2("content", 256).alias("sha256"), F.endswith(rel, F.lit(".part")).alias("is_part"))


def discover_exports(spark: SparkSession, root: str) -> DataFrame:
    """Folders with an export, by path: json (result.json) or html (messages.html)."""
    return classify_exports(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(F.col("path"), root).alias("rel_path")))


def classify_exports(files: DataFrame) -> DataFrame:
    """folder, kind and number of export files of an inventory with rel_path, by folder. A folder with both kinds is JSON."""
    p = F.col("rel_path")
    name, folder = F.regexp_extract(p, "([^/]*)$", 1), F.regexp_replace(p, "/?[^/]*$", "")
    kinds = files.select(folder.alias("folder"), F.when(name == "result.json", "json").when(name.rlike(r"^messages\d*\.html$"), "html").alias("kind")).where("kind is not null")
    return kinds.groupBy("folder").agg(F.max("kind").alias("kind"), F.count("*").alias("n_files")).orderBy("folder")


def _export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).option("multiLine", True).json(path)


def read_export_owner(spark: SparkSession, path: str) -> DataFrame:
    """user_id and name of a full export's owner; one row at most."""
    who = _export(spark, path).where("personal_information is not null").select("personal_information.*")
    return who.select("user_id", F.nullif(F.trim(F.concat_ws(" ", "first_name", "last_name")), F.lit("")).alias("name"))


def export_peer_id(kind: str, number: str) -> Column:
    """Ids by kind of chat: channels and groups are negative."""
    k, n = F.col(kind), F.col(number)
    return F.when(k.contains("channel") | k.contains("supergroup"), F.lit(-1_000_000_000_000) - n).when(k.contains("group"), -n).otherwise(n)


def export_kind(kind: str) -> Column:
    k = F.col(kind)
    return F.when(k.contains("channel"), "channel").when(k.contains("group"), "group").otherwise("user")


def text_of(chunks: str) -> Column:
    return F.array_join(F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit(""))), "")


def entities_of(chunks: str) -> Column:
    """Entities with UTF-16 offsets that run along the chunks; plain ones only move the offset."""
    width = lambda c: (F.octet_length(F.encode(F.coalesce(c["text"], F.lit("")), "UTF-16BE")) / 2).cast("int")
    n = F.size(chunks)
    offsets = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.aggregate(F.slice(chunks, F.lit(1), i), F.lit(0), lambda acc, c: acc + width(c)))
    items = F.filter(F.zip_with(chunks, offsets, lambda c, o: F.struct(c["type"].alias("type"), o.alias("offset"), width(c).alias("length"), c["href"].alias("url"), c["document_id"].alias("custom_emoji_id"))), lambda e: e["type"] != "plain")
    return F.when((n > 0) & (F.size(items) > 0), F.to_json(items))


def export_reactions(reactions: str) -> Column:
    """The export's list as canonical JSON; blank emoji go, a missing count is one."""
    kept = F.filter(reactions, lambda r: F.coalesce(F.trim(r["emoji"]), r["document_id"], F.lit("")) != "")
    rows = F.transform(kept, lambda r: F.struct(F.struct(r["type"].alias("type"), r["emoji"].alias("emoji"), r["document_id"].alias("custom_emoji_id")).alias("reaction"), F.coalesce(r["count"], F.lit(1)).alias("count")))
    return F.when(F.size(rows) > 0, F.to_json(F.struct(rows.alias("results"))))


def export_media_kind(media_type: str, photo: str, mime: str) -> Column:
    t = F.col(media_type)
    return (
        F.when(F.col(photo).isNotNull(), "photo").when(t == "video_file", "video").when(t == "voice_message", "voice").when(t == "video_message", "video_note").when(t == "audio_file", "audio")
        .when(t == "sticker", "sticker").when(t == "animation", "animation").when(F.col(mime).startswith("image/"), "photo").otherwise("document")
    )


def service_label(action: str, actor: str, title: str) -> Column:
    """What a service event says."""
    a, who = F.col(action), F.coalesce(F.col(actor), F.lit("Someone"))
    named = lambda verb: F.concat(who, F.lit(f" {verb} \""), F.coalesce(F.col(title), F.lit("")), F.lit('"'))
    return (
        F.when(a == "create_group", named("created group")).when(a == "create_channel", named("created channel")).when(a == "edit_group_title", named("changed group title to"))
        .when(a == "pin_message", F.concat(who, F.lit(" pinned a message"))).when(a == "invite_members", F.concat(who, F.lit(" invited members"))).when(a == "remove_members", F.concat(who, F.lit(" removed members")))
        .when(a == "join_group_by_link", F.concat(who, F.lit(" joined by link"))).when(a == "phone_call", F.concat(who, F.lit(" called"))).otherwise(F.concat(who, F.lit(": "), F.replace(a, F.lit("_"), F.lit(" "))))
    )


def read_export_json(spark: SparkSession, path: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(peers, messages, media) of a single-chat or full export. Ids <= 0 are dropped; unknown dates become now.

    A file is one row of one task; read_large_export cuts files.
    """
    raw = _export(spark, path)
    chats = raw.where("messages is not null").select("name", "type", "id", "messages").union(raw.where("chats is not null").select(F.explode("chats.list").alias("c")).select("c.name", "c.type", "c.id", "c.messages"))
    one = chats.select(export_peer_id("type", "id").alias("peer_id"), F.explode("messages").alias("m")).select("peer_id", "m.*")
    return _imported(chats, one, now)


def read_large_export(spark: SparkSession, path: str, now: int, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of files of any size, each of which is read by many tasks. Runs jobs when it is called."""
    chats, messages = split_export(spark, path, split_bytes)
    peers = chats.select("file", "chat_no", export_peer_id("type", "id").alias("peer_id"))
    return _imported(chats, messages.join(peers, ["file", "chat_no"]).select("peer_id", "m.*"), now)


def _imported(chats: DataFrame, one: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """peers, messages and media of chats (name, type, id) and their messages (peer_id and the export's fields)."""
    chats = chats.select(export_peer_id("type", "id").alias("peer_id"), export_kind("type").alias("peer_type"), "name")
    one = one.where("id > 0")
    service = F.col("type") == "service"
    edited = F.col("edited_unixtime").cast("long")
    messages = one.select(
        "peer_id", F.col("id").alias("message_id"), F.coalesce(F.col("date_unixtime").cast("long"), F.lit(now)).cast("long").alias("date"), F.regexp_extract("from_id", r"(\d+)$", 1).try_cast("long").alias("sender_id"), F.col("from").alias("sender_name"),
        F.when(service, service_label("action", "actor", "title")).otherwise(text_of("text_entities")).alias("text"), entities_of("text_entities").alias("entities_json"), edited.alias("edit_date"), F.when(edited.isNotNull(), "edited").otherwise("active").alias("state"),
        F.col("reply_to_message_id").alias("reply_to_msg_id"), F.when(F.col("reply_to_message_id").isNotNull(), F.col("peer_id")).alias("reply_to_peer_id"), F.when(F.col("forwarded_from").isNotNull(), F.to_json(F.struct(F.col("forwarded_from").alias("from_name")))).alias("forward_json"),
        export_reactions("reactions").alias("reactions_json"), service.alias("is_service"),
    )
    file = F.coalesce("file", "photo")
    skipped = file.startswith("(")
    media = one.where(file.isNotNull()).select("peer_id", F.col("id").alias("message_id"), F.concat(F.lit("file_"), F.sha2(file, 256).substr(1, 16)).alias("media_id"), export_media_kind("media_type", "photo", "mime_type").alias("kind"), "mime_type",
        F.coalesce("file_size", "photo_file_size").alias("size_bytes"), F.when(~skipped, file).alias("local_rel_path"), F.when(skipped, "skipped").otherwise("completed").alias("download_status"))
    updated = messages.groupBy("peer_id").agg(F.max("date").alias("updated_at"))
    return chats.select("peer_id", "peer_type", "name").dropDuplicates(["peer_id"]).join(updated, "peer_id", "left"), messages, media


_DIV = re.compile(r'<div class="message ([^"]*)" id="(?:go_to_)?message(-?\d+)">')
_TAG = re.compile(r"<(/?)(\w+)[^>]*?(?:href=\"([^\"]*)\")?[^>]*>")
_KINDS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "s": "strikethrough", "code": "code", "pre": "pre", "a": "link", "blockquote": "blockquote"}


def _plain(markup: str) -> tuple[str, list[dict]]:
    """Text and entities, with UTF-16 offsets, of a message's inline markup."""
    out, entities, open_, at, width = [], [], [], 0, 0

    def add(text: str) -> None:
        nonlocal width
        out.append(text)
        width += len(text.encode("utf-16-le")) // 2

    for m in _TAG.finditer(markup):
        add(html_lib.unescape(markup[at : m.start()]))
        at = m.end()
        if m[2] == "br":
            add("\n")
        elif m[2] in _KINDS and not m[1]:
            open_.append((m[2], width, m[3]))
        elif m[2] in _KINDS and open_ and open_[-1][0] == m[2]:
            tag, start, href = open_.pop()
            if width > start:
                entities.append({"type": _KINDS[tag], "offset": start, "length": width - start} | ({"url": html_lib.unescape(href)} if href else {}))
    add(html_lib.unescape(markup[at:]))
    text = "".join(out)
    return text.strip("\n"), entities


_HTML = pa.schema([("folder", pa.string()), ("file_no", pa.int32()), ("elem_no", pa.int32()), ("message_id", pa.int64()), ("is_service", pa.bool_()), ("joined", pa.bool_()), ("sender_name", pa.string()), ("date_text", pa.string()), ("text", pa.string()), ("entities", pa.string()), ("reply_to_msg_id", pa.int64()), ("media_path", pa.string()), ("title", pa.string())])
_HTML_DDL = "folder string, file_no int, elem_no int, message_id long, is_service boolean, joined boolean, sender_name string, date_text string, text string, entities string, reply_to_msg_id long, media_path string, title string"


_TITLE, _NAME = (re.compile(p, re.S) for p in (r'<div class="text bold">\s*(.*?)\s*</div>', r'<div class="from_name">\s*(.*?)\s*(?:<span|</div>)'))
_SERVICE, _TEXT = (re.compile(p, re.S) for p in (r'<div class="body details">\s*(.*?)\s*</div>', r'<div class="text">\s*(.*?)\s*</div>'))
_DATE, _REPLY = re.compile(r'class="pull_right date details" title="([^"]*)"'), re.compile(r'href="[^"]*#go_to_message(\d+)"')
_PATH = re.compile(r'<a class="[^"]*(?:photo_wrap|media_\w+|video_file_wrap)[^"]*" href="([^"]*)"')


def _elements(batches):
    import json

    for batch in batches:
        rows = {name: [] for name in _HTML.names}
        for folder, file_no, page in zip(*(batch.column(c).to_pylist() for c in ("folder", "file_no", "html"))):
            title = _TITLE.search(page)
            title = title and html_lib.unescape(title[1])
            marks = list(_DIV.finditer(page))
            for n, m in enumerate(marks):
                at, end = m.end(), marks[n + 1].start() if n + 1 < len(marks) else len(page)
                find = lambda p: (x := p.search(page, at, end)) and x[1]  # noqa: B023, E731
                classes = m[1].split()
                service = "service" in classes
                body = find(_SERVICE if service else _TEXT)
                text, entities = (_plain(body) if "<" in body else (html_lib.unescape(body).strip("\n"), [])) if body else (None, [])
                name = find(_NAME)
                reply, path = (find(_REPLY), find(_PATH)) if page.find("href", at, end) >= 0 else (None, None)
                found = (folder, file_no, n, int(m[2]), service, "joined" in classes, name and html_lib.unescape(name), find(_DATE), text, json.dumps(entities) if entities else None, reply and int(reply), path, title)
                for column, value in zip(rows.values(), found):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=_HTML)


def export_date(text: str) -> Column:
    """`dd.mm.yyyy HH:MM:SS UTC+hh:mm` as epoch seconds; null if it isn't one."""
    c = F.regexp_extract(text, r"^(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2})", 1)
    zone = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 2)
    shift = F.when(zone != "", zone.cast("int") * 3600 + F.when(zone.startswith("-"), -1).otherwise(1) * minutes.cast("int") * 60).otherwise(0)
    # read as UTC, whatever the session's zone
    return F.unix_timestamp(F.try_to_timestamp(F.concat(F.nullif(c, F.lit("")), F.lit(" +0000")), F.lit("dd.MM.yyyy HH:mm:ss xx"))) - shift


#: Names of the months in date dividers.
MONTHS = {
    1: "january jan января январь янв січня січень січ januar janvier enero gennaio", 2: "february feb февраля февраль фев лютого лютий лют februar février fevrier febrero febbraio",
    3: "march mar марта март мар березня березень бер märz maerz mars marzo", 4: "april apr апреля апрель апр квітня квітень квіт avril abril aprile",
    5: "may мая май травня травень трав mai mayo maggio", 6: "june jun июня июнь июн червня червень черв juni juin junio giugno",
    7: "july jul июля июль июл липня липень лип juli juillet julio luglio", 8: "august aug августа август авг серпня серпень серп août aout agosto",
    9: "september sep sept сентября сентябрь сен сент вересня вересень вер septembre septiembre settembre", 10: "october oct октября октябрь окт жовтня жовтень жовт oktober octobre octubre ottobre",
    11: "november nov ноября ноябрь ноя нояб листопада листопад лист novembre noviembre", 12: "december dec декабря декабрь дек грудня грудень груд dezember décembre decembre diciembre dicembre",
}
#: Words of dividers that say nothing.
FILLERS = ("de", "г.", "г", "р.", "р", "года", "року", "d'")


def date_divider(text: str | Column) -> Column:
    """Epoch seconds of a divider's day: numbers with the year at either end, or day, month's name and year; null for other texts."""
    line = F.trim(text)
    part = F.split(line, "[-./]")
    number = lambda c: F.when(c.rlike(r"^\d{1,4}$"), c.cast("int"))
    at = lambda c, n: F.get(c, F.lit(n))
    first, last = (F.length(at(part, n)) == 4 for n in (0, 2))
    digits = F.when((F.size(part) == 3) & first, F.struct(number(at(part, 0)).alias("y"), number(at(part, 1)).alias("m"), number(at(part, 2)).alias("d"))).when(
        (F.size(part) == 3) & last, F.struct(number(at(part, 2)).alias("y"), number(at(part, 1)).alias("m"), number(at(part, 0)).alias("d")))
    words = F.filter(F.split(line, r"\s+"), lambda w: ~F.lower(w).isin(*FILLERS) & (w != ""))
    bare = lambda w: F.regexp_replace(w, r"\.+$", "")
    names = F.create_map(*(F.lit(x) for m, all_ in MONTHS.items() for w in all_.split() for x in (w, m)))
    spelt = F.when(F.size(words) >= 3, F.struct(number(bare(F.element_at(words, -1))).alias("y"), F.try_element_at(names, F.lower(bare(at(words, 1)))).alias("m"), number(bare(at(words, 0))).alias("d")))
    found = F.coalesce(F.when((digits["y"] >= 1970) & digits["m"].between(1, 12) & digits["d"].between(1, 31), digits), F.when((spelt["y"] >= 1970) & spelt["d"].between(1, 31), spelt))
    day = F.try_to_date(F.concat_ws("-", found["y"].cast("string"), found["m"].cast("string"), found["d"].cast("string")), "y-M-d")
    return F.when(found.isNotNull(), F.unix_date(day).cast("long") * 86400)


def read_export_html(spark: SparkSession, root: str, now: int) -> DataFrame:
    """Messages of the HTML exports below a folder."""
    return parse_export_pages(read_pages(spark, root), now)


def parse_export_pages(pages: DataFrame, now: int) -> DataFrame:
    """Messages of export pages (page, html): pages in order, senders carried over joined rows, dates (those of dividers too) carried forward.

    Elements are cut out of each page in Python, once, and written; what spans pages is carried from one stretch of elements to the next.
    """
    name = F.regexp_extract("page", r"([^/]*)$", 1)
    pages = pages.where(name.rlike(r"^messages\d*\.html$")).select(F.regexp_replace("page", "/?[^/]*$", "").alias("folder"), F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), F.lit(1)).alias("file_no"), "html")
    rows = pages.mapInArrow(_elements, _HTML_DDL).withColumn("_order", F.col("file_no").cast("long") * (1 << 20) + F.col("elem_no"))
    # dividers have ids that aren't positive, and their text is a day
    real, order = F.col("message_id") > 0, F.col("_order")
    date = F.when(real, export_date("date_text")).otherwise(date_divider(F.coalesce("text", F.lit(""))))
    sender = F.when(real & ~F.col("is_service"), F.col("sender_name"))
    # ranges are cut by a sample, which would parse every page and date once more
    rows = staged(rows.withColumns({"_date": date, "_sender": sender}))
    last, seen = lambda c: F.last(c, ignorenulls=True), lambda c: (F.max_by(c, F.when(F.col(c).isNotNull(), order)), lambda x: F.last(x, ignorenulls=True))
    rows, block = carried(rows, ("folder",), "_order", _date_before=seen("_date"), _sender_before=seen("_sender"))
    sofar = block.rowsBetween(Window.unboundedPreceding, 0)
    date, sender = F.coalesce(last("_date").over(sofar), F.col("_date_before")), F.coalesce(last("_sender").over(sofar), F.col("_sender_before"))
    rows = rows.withColumns({"date": F.coalesce(date, F.lit(now)).cast("long"), "sender_name": F.when(~F.col("is_service"), F.coalesce("sender_name", F.when(F.col("joined"), sender)))}).where(real)
    return rows.select("folder", "title", "message_id", "date", "sender_name", "text", F.col("entities").alias("entities_json"), "reply_to_msg_id", "media_path", F.coalesce(F.col("media_path").startswith("("), F.lit(False)).alias("media_skipped"), "is_service")


def read_search_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, manifest, prefixes) of a written search index; shard_id prunes partitions."""
    return spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/manifest"), spark.read.parquet(f"{folder}/prefixes")
