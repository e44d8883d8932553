"""Areas, times and feed probes."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_area(area: str) -> tuple[float, float, float, float]:
    """(south, west, north, east) of `lat_min,lon_min,lat_max,lon_max`."""
    parts = area.split(",")
    if len(parts) != 4:
        raise ValueError(f"an area has four numbers, not {area!r}")
    south, west, north, east = map(float, parts)
    return south, west, north, east


def area_ring(area: str) -> list[list[list[float]]]:
    """The closed ring of an area as a polygon, longitude first."""
    south, west, north, east = parse_area(area)
    return [[[west, south], [east, south], [east, north], [west, north], [west, south]]]


def in_area(lat: Column, lon: Column, area: str) -> Column:
    south, west, north, east = parse_area(area)
    return lat.between(south, north) & lon.between(west, east)


def parse_lookback(text: str) -> dt.timedelta:
    """`24h` or `7d`, in either case."""
    found = re.fullmatch(r"(\d+)([hd])", text.strip().lower())
    if not found:
        raise ValueError(f"not a number of hours or days: {text!r}")
    return dt.timedelta(**{"hours" if found[2] == "h" else "days": int(found[1])})


def parse_since(text: str, now: dt.datetime) -> dt.datetime:
    """`Nd` before `now`, or an ISO time, taken as UTC if it has no offset."""
    if re.fullmatch(r"\d+d", text.strip()):
        return now - parse_lookback(text)
    value = dt.datetime.fromisoformat(text.strip())
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def yesterday_at_16(now: Column, zone: str = "Europe/Oslo") -> Column:
    """16:00 in the zone on the day before `now`, as a UTC timestamp."""
    day = F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), 1)
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 16 HOURS"), zone)


def feed_status(status: Column, body: Column) -> Column:
    """Class of a probed feed: ok, transient, warn or bad.

    `status` is an HTTP status as text, or `err`; `body` the first bytes as text.
    """
    code = status.try_cast("int")
    clean = F.regexp_replace(F.coalesce(body, F.lit("")), "^[﻿ \t\r\n]+", "")
    head = F.lower(F.left(clean, F.lit(400)))
    start = F.left(head, F.lit(200))
    declared = head.startswith("<?xml") & (head.contains("<rss") | head.contains("<feed"))
    page = head.contains("<html") | head.contains("<body") | head.contains("<!doctype")
    bare = (start.contains("<rss") | start.contains("<feed")) & ~page
    return (
        F.when(code.isNull() | (code >= 500), "bad")
        .when(code == 429, "transient")
        .when(code >= 300, "warn")
        .when(declared | bare, "ok")
        .otherwise("warn")
    )
