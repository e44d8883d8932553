"""From raw records to items: the projection of each connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as T

#: Columns of a mapped item.
ITEM = ("source", "source_type", "url", "title", "ts", "lang", "summary", "body", "discipline", "admiralty_reliability")


def _item(rows: DataFrame, **columns: Column) -> DataFrame:
    """The item's columns, and what the rows have besides."""
    filled = {c: columns.get(c, F.lit(None).cast("string")) for c in ITEM}
    rest = [c for c in rows.columns if c not in ITEM]
    return rows.select(*rest, *[v.alias(c) for c, v in filled.items()])


def chat_items(messages: DataFrame) -> DataFrame:
    """(channel, id, date, text): the first line is the title."""
    number = F.col("id").cast("string")
    body = F.coalesce("text", F.lit(""))
    channel = F.regexp_replace("channel", "^@+", "")
    return _item(
        messages, source=F.col("channel"), source_type=F.lit("telegram"), url=F.concat(F.lit("https://t.me/"), channel, F.lit("/"), number),
        title=T.first_line(body, F.concat(F.lit("telegram:"), "channel", F.lit(":"), number)), ts=F.col("date"), lang=F.lit("und"),
        summary=F.left(body, F.lit(500)), body=body, discipline=F.lit("SOCMINT"), admiralty_reliability=F.lit("C3"),
    )


def feed_items(entries: DataFrame) -> DataFrame:
    """(id, author, title, url, html, created_on_time in seconds): entries of a feed reader."""
    blank = lambda c, otherwise: F.coalesce(F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")), otherwise)
    return _item(
        entries, source=blank("author", F.lit("freshrss")), source_type=F.lit("rss"), url=blank("url", F.concat(F.lit("fever://item/"), F.col("id").cast("string"))),
        title=blank("title", F.lit("(untitled)")), ts=F.timestamp_seconds(F.coalesce("created_on_time", F.lit(0))), lang=F.lit("en"), summary=T.html_to_text("html"),
    )


def vessel_items(reports: DataFrame) -> DataFrame:
    """(report: JSON): positions of ships under the names that the sources use."""
    value = F.try_parse_json("report")
    get = lambda kind, *names: F.coalesce(*[F.try_variant_get(value, f"$.{n}", kind) for n in names], F.lit(None).cast(kind))
    mmsi = F.coalesce(get("string", "mmsi"), F.lit("unknown"))
    name = F.coalesce(F.nullif(get("string", "name"), F.lit("")), F.nullif(get("string", "vesselName"), F.lit("")), F.concat(F.lit("vessel-"), mmsi))
    lat, lon = get("double", "latitude", "lat"), get("double", "longitude", "lon")
    speed, course = get("string", "speedOverGround", "sog"), get("string", "courseOverGround", "cog")
    place = F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("Position: %.5f, %.5f", lat, lon))
    parts = [F.concat(F.lit("MMSI: "), mmsi), place, F.concat(F.lit("SOG: "), speed, F.lit(" kn")), F.concat(F.lit("COG: "), course, F.lit("°"))]
    title = F.concat(F.lit("AIS: "), name, F.lit(" ("), mmsi, F.lit(") near "), F.coalesce(get("string", "destination"), F.lit("Unknown")))
    body = F.coalesce(*[F.nullif(get("string", n), F.lit("")) for n in ("note", "notes", "remark", "remarks")])
    return _item(
        reports, source=F.lit("barentswatch"), source_type=F.lit("ais"), url=F.concat(F.lit("urn:mmsi:"), mmsi), title=title,
        ts=F.try_to_timestamp(get("string", "msgtime", "timestamp")), lang=F.lit("und"), summary=F.concat_ws("; ", *parts), body=body,
        discipline=F.lit("MASINT/AIS"), admiralty_reliability=F.lit("A1"),
    )


def mail_items(mails: DataFrame) -> DataFrame:
    """(protocol, host, mailbox, uid, sender, subject, text, fetched_at): parsed mails, by their time of arrival."""
    url = F.concat(F.col("protocol"), F.lit("://"), F.col("host"), F.lit("/"), F.coalesce("mailbox", F.lit("")), F.lit("/"), F.col("uid"))
    return _item(
        mails, source=F.concat(F.col("protocol"), F.lit("://"), F.col("host")), source_type=F.col("protocol"), url=url,
        title=F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("(no subject)")), ts=F.col("fetched_at"), lang=F.lit("und"),
        summary=T.snippet("text"), body=T.blank_to_null("text"), discipline=F.lit("HUMINT"),
    )


def api_mail_items(messages: DataFrame) -> DataFrame:
    """(id, headers array<struct<name,value>>, snippet, received_at): messages of a mail API."""
    header = lambda n: F.try_element_at(F.filter("headers", lambda h: F.lower(h["name"]) == n), F.lit(1))["value"]
    return _item(
        messages, source=F.coalesce(header("from"), F.lit("unknown")), source_type=F.lit("gmail"), url=F.concat(F.lit("gmail://"), F.col("id")),
        title=F.coalesce(F.nullif(F.trim(header("subject")), F.lit("")), F.lit("(no subject)")), ts=F.col("received_at"), lang=F.lit("und"),
        summary=F.left(F.coalesce("snippet", F.lit("")), F.lit(500)), discipline=F.lit("HUMINT"),
    )


def clip_items(clips: DataFrame, now) -> DataFrame:
    """(path, meta map<string,string>, text): Markdown clips with their front matter; a date without time is `now`."""
    given = F.col("meta")["date"]
    ts = F.coalesce(F.when(given.rlike("[T ][0-9]{2}:"), F.try_to_timestamp(given)), now)
    stem = F.regexp_extract("path", r"([^/]+?)(\.md)?$", 1)
    get = lambda k: F.nullif(F.trim(F.col("meta")[k]), F.lit(""))
    return _item(
        clips, source=F.coalesce(get("source"), F.lit("obsidian")), source_type=F.lit("obsidian"), url=F.coalesce(get("url"), F.concat(F.lit("obsidian://"), stem)),
        title=F.coalesce(get("title"), stem), ts=ts, lang=F.coalesce(get("lang"), T.guess_language("text")), summary=T.snippet("text"),
        body=T.blank_to_null("text"), discipline=F.lit("OSINT"),
    )


def video_items(videos: DataFrame) -> DataFrame:
    """(channel, id, title, uploaded_at, transcript, blob_hash): a placeholder transcript is no body."""
    stub = F.coalesce(F.col("transcript").rlike(r"^\s*\["), F.lit(True))
    return _item(
        videos, source=F.col("channel"), source_type=F.lit("yt"), url=F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")), title=F.col("title"),
        ts=F.col("uploaded_at"), lang=F.lit("und"), summary=F.when(~stub, T.snippet("transcript")), body=F.when(~stub, T.blank_to_null("transcript")), discipline=F.lit("OSINT"),
    )
