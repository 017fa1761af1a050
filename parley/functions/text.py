"""Column functions over message and label text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Unicode-aware whitespace patterns
WS = r"(?U)\s+"
WS_EDGES = r"(?U)^\s+|\s+$"


def trim_ws(c: Column) -> Column:
    """Strip every kind of whitespace (tabs, newlines, no-break spaces) at both ends."""
    return F.regexp_replace(c, WS_EDGES, "")


def one_line(c: Column) -> Column:
    """Collapse whitespace runs into one space and strip the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def word_count(c: Column) -> Column:
    """Words separated by whitespace; a blank text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def normalize_label(c: Column) -> Column:
    """Canonical spelling of a topic or entity label; case is kept."""
    return one_line(c)


def iso(c: Column) -> Column:
    """ISO-8601 UTC text with milliseconds, the external form of every timestamp."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_ts(c: Column, strict: bool = True) -> Column:
    """Parse ISO text to a UTC timestamp cut to milliseconds.

    ``strict`` fails the job on an unreadable value; otherwise it becomes null
    and the caller quarantines the row.
    """
    parsed = F.to_timestamp(c) if strict else F.try_to_timestamp(c)
    return F.date_trunc("millisecond", parsed)


def safe_segment(c: Column) -> Column:
    """Folder-safe form of a name: no separators, whitespace, ``..`` or edge dots."""
    x = F.regexp_replace(c, r"[/\\]", "_")
    x = F.regexp_replace(x, WS, "_")
    x = F.regexp_replace(x, r"\.{2,}", "_")
    x = F.trim(F.regexp_replace(x, r"^\.+|\.+$", ""))
    return F.when(x == "", F.lit("_")).otherwise(x)


def dir_segment(id_col: Column, name_col: Column, mode: str) -> Column:
    """Folder name of a guild or channel in mode ``id``, ``name`` or ``name-id``."""
    name = trim_ws(F.coalesce(name_col, F.lit("")))
    by_id = safe_segment(id_col)
    if mode == "id":
        return by_id
    named = safe_segment(name)
    if mode == "name-id":
        named = F.concat(named, F.lit("-"), by_id)
    return F.when(name == "", by_id).otherwise(named)


def message_line(id_: Column, author: Column, created_at: Column, content: Column) -> Column:
    """Prompt line of one message: header with id, author and time, then the text."""
    text = trim_ws(F.regexp_replace(content, r"\r?\n", " "))
    return F.concat(
        F.lit("[id="), id_, F.lit("] "), author, F.lit(" @ "), iso(created_at), F.lit("\n"), text
    )


def ceil_div(chars: Column, per_token: float) -> Column:
    return F.ceil(chars / F.lit(per_token)).cast("bigint")


def used_refs(refs: Column) -> Column:
    """Distinct citation marks such as ``D3`` found in a list of free-form entries."""
    joined = F.upper(F.array_join(refs, " "))
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"D\d+"), F.lit(0)))


def clip(c: Column, limit: int | None = None) -> Column:
    """Logged text, whole; a ``limit`` cuts it there, with a note of its full length."""
    if limit is None:
        return c
    note = F.concat(
        F.lit("\n… [cut, "), F.length(c).cast("string"), F.lit(" characters in all]")
    )
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), note)).otherwise(c)


def author_label(display_name: Column, username: Column, author_id: Column) -> Column:
    return F.coalesce(display_name, username, author_id)
