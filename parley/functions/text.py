"""Column expressions over text: names, paths, escapes, snippets, sizes and UTF-16 offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reply_snippet(text: str | Column, state: str | Column, most: int = 100) -> Column:
    """The first line that isn't blank, cut with `...`; stand-ins for deleted messages and ones without text."""
    line = F.get(F.filter(F.split(_c(text), "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    cut = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)
    return F.when(_c(state) == "deleted", F.lit("Deleted message")).otherwise(F.coalesce(cut, F.lit("Attachment")))


def slug(text: str | Column, most: int = 64, default: str = "chat") -> Column:
    """Lower-case letters and digits joined by single underscores."""
    plain = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", "_")
    cut = F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, most)
    return F.when(cut == "", F.lit(default)).otherwise(F.coalesce(F.regexp_replace(cut, "_+$", ""), F.lit(default)))


def safe_file_name(text: str | Column, most: int = 120) -> Column:
    """Without separators, control characters and what common file systems forbid."""
    plain = F.regexp_replace(F.regexp_replace(_c(text), r'[/\\:*?"<>|\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(plain == "", F.lit("file")).otherwise(F.substring(plain, 1, most))


def content_path(sha256: str | Column, extension: str | Column) -> Column:
    """media/ab/<sha256>.<extension>"""
    return F.concat(F.lit("media/"), F.substring(_c(sha256), 1, 2), F.lit("/"), _c(sha256), F.lit("."), _c(extension))


def html_escape(text: str | Column) -> Column:
    out = _c(text)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def html_unescape(text: str | Column) -> Column:
    out = _c(text)
    for safe, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return out


def json_for_script(text: str | Column) -> Column:
    """JSON that can stand in a script element."""
    out = _c(text)
    for plain, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


#: Link schemes that an export may carry.
SCHEMES = ("http", "https", "mailto", "tel", "tg", "ftp")


def safe_href(url: str | Column) -> Column:
    """The link if its scheme is allowed or it has none, else null."""
    scheme = F.regexp_extract(F.lower(F.trim(_c(url))), "^([a-z][a-z0-9+.-]*):", 1)
    return F.when((scheme == "") | scheme.isin(*SCHEMES), F.trim(_c(url)))


def format_size(size: str | Column) -> Column:
    """B, KB, MB or GB with one decimal from KB on."""
    s = _c(size)
    part = lambda unit, name: F.concat(F.format_string("%.1f", s / unit), F.lit(f" {name}"))
    return F.when(s < 1024, F.concat(s.cast("string"), F.lit(" B"))).when(s < 1 << 20, part(1 << 10, "KB")).when(s < 1 << 30, part(1 << 20, "MB")).otherwise(part(1 << 30, "GB"))


def utf16_length(text: str | Column) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def utf16_slice(text: str | Column, offset: str | Column, length: str | Column) -> Column:
    """The text at a UTF-16 offset, as entities count."""
    raw = F.encode(_c(text), "UTF-16BE")
    return F.decode(F.substring(raw, _c(offset) * 2 + 1, _c(length) * 2), "UTF-16BE")


def relative_path(source: str | Column, target: str | Column) -> Column:
    """The link from one file to another: the shared folders go, `../` for each one left."""
    a, b = F.split(_c(source), "/"), F.split(_c(target), "/")
    folders = F.slice(a, 1, F.size(a) - 1)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(folders))), lambda n: (n <= F.size(folders)) & (n < F.size(b)) & (F.array_join(F.slice(a, F.lit(1), n), "/") == F.array_join(F.slice(b, F.lit(1), n), "/"))))
    return F.concat(F.repeat(F.lit("../"), F.size(folders) - shared), F.array_join(F.slice(b, shared + 1, F.size(b)), "/"))


def path_finding(path: str | Column) -> Column:
    """The code of what is wrong with a relative path, or null. A root within a path can't stand anywhere but at its start."""
    c = _c(path)
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    return (
        F.when(F.contains(c, F.lit("\x00")), "PATH_CONTAINS_NULL_BYTE").when(c.startswith("/"), "PATH_ABSOLUTE_ESCAPE").when(c.startswith("\\") | (F.substring(c, 2, 1) == ":"), "PATH_WINDOWS_DRIVE_ESCAPE")
        .when(p.rlike(r"(^|/)\.\.(/|$)"), "PATH_TRAVERSAL_ESCAPE")
    )


#: Symbols that get the emoji variation selector.
PLAIN_EMOJI = "\u2764\u263a\u2639\u2600\u270c\u270b\u270d\u2763\u26a1\u2601\u2614\u2615\u2753\u2757"


def normalize_emoji(emoji: str | Column) -> Column:
    return F.regexp_replace(_c(emoji), f"([{PLAIN_EMOJI}])(?!\ufe0f)", "$1\ufe0f")


def base_sender_name(name: str | Column) -> Column:
    """A sender's name without the bot that it wrote through."""
    return F.trim(F.substring_index(_c(name), " via @", 1))


#: Fixed value: what a suggested photo's service text says.
SUGGESTS = "suggests to use this photo"


def is_outgoing(sender_id: str | Column, sender_name: str | Column, text: str | Column, own_id: Column, own_name: Column, contact: Column, personal: Column) -> Column:
    """Whether the archive's owner wrote a message: by id, by name or the name that the text starts with, and in personal chats by not being the contact."""
    who, said = base_sender_name(sender_name), F.trim(_c(text))
    alike = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    begins = lambda name: F.coalesce(F.startswith(said, name), F.lit(False))
    known = own_name.isNotNull()
    return (
        F.when(F.coalesce(_c(sender_id) == own_id, F.lit(False)), True).when(known & alike(who, own_name), True).when(known & alike(who, contact), False)
        .when(known & begins(own_name), True).when(known & begins(contact), False).when(personal & who.isNotNull() & contact.isNotNull(), ~alike(who, contact))
        .when(personal & contact.isNotNull() & F.coalesce(F.contains(said, F.lit(SUGGESTS)), F.lit(False)), ~begins(contact)).otherwise(False)
    )


def photo_suggestion_text(text: str | Column, sender_name: str | Column, contact: Column, outgoing: Column) -> Column:
    """The text of a suggested photo as its reader is told; other texts stay."""
    mine = F.concat(F.lit("You suggested this photo for "), F.coalesce(contact, F.lit("contact")), F.lit("'s Telegram profile."))
    theirs = F.concat(F.coalesce(_c(sender_name), contact, F.lit("Contact")), F.lit(" suggested this photo for your Telegram profile."))
    return F.when(F.contains(_c(text), F.lit(SUGGESTS)), F.when(outgoing, mine).otherwise(theirs)).otherwise(_c(text))
