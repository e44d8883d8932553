"""Identifiers and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import text as T

#: The discipline of each type of source, and all disciplines.
DISCIPLINE_OF = {
    "rss": "OSINT", "obsidian": "OSINT", "yt": "OSINT", "youtube": "OSINT", "acled": "OSINT",
    "imap": "HUMINT", "gmail": "HUMINT", "pop3": "HUMINT", "telegram": "SOCMINT",
    "barentswatch": "MASINT/AIS", "ais": "MASINT/AIS",
}
DISCIPLINES = ("OSINT", "HUMINT", "SOCMINT", "MASINT", "GEOINT", "SIGINT", "MASINT/AIS")


def item_id(source_type: Column, url: Column, title: Column) -> Column:
    """Content hash of an item: time, summary and body don't count."""
    parts = [source_type, F.coalesce(url, F.lit("")), title]
    return F.sha2(F.concat(parts[0], F.lit("\0"), parts[1], F.lit("\0"), parts[2]), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def alert_id(item: Column, tier: Column) -> Column:
    """The 16-digit key under which an alert is sent once."""
    return F.left(F.sha2(F.concat(item, F.lit("|"), tier), 256), F.lit(16))


def api_key(user: Column, password: Column) -> Column:
    return F.md5(F.concat(user, F.lit(":"), password))


def discipline(given: Column, source_type: Column) -> Column:
    """The given discipline or the source type's; null (to be rejected) for an unknown type."""
    pairs = [F.lit(x) for pair in DISCIPLINE_OF.items() for x in pair]
    return F.coalesce(given, F.try_element_at(F.create_map(*pairs), source_type))


def is_blob_hash(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


def blob_path(value: Column) -> Column:
    """Where a blob lies: two levels of folders by the leading digits of its hash."""
    return F.concat_ws("/", F.substring(value, 1, 2), F.substring(value, 3, 2), value)


def percent_encoded(value: Column) -> Column:
    """Everything but unreserved characters percent-encoded, in UTF-8."""
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def note_link(item: Column, vault: str = "obsidian", folder: str = "brief-outbox") -> Column:
    """Link that opens an item's note."""
    path = F.concat(F.lit(f"{folder}/" if folder else ""), T.note_name(item))
    return F.concat(F.lit("obsidian://open?vault="), percent_encoded(F.lit(vault)), F.lit("&file="), percent_encoded(path))
