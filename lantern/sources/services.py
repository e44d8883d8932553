"""Services read as planned, partitioned data sources: positions of vessels, and mail behind a tool server.

`lantern_vessels` takes filters of a query to its requests: bounds on latitude and longitude shrink the
polygon that is asked for, a bound on the time raises the start, and nothing is asked where they
leave no area. `lantern_tool_mail` lists the ids of messages while the query is planned, and each
task fetches a slice of them in a session of its own.

Filters reach a Python source only with `spark.sql.python.filterPushdown.enabled`; without it the
answers are the same, and more is fetched.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lantern.functions import text as T
from lantern.sources.remote import fetch_with_retries

VESSEL = "report string, mmsi string, latitude double, longitude double, at timestamp"
TOOL_MAIL = "id string, message string"


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes, dict[str, str]]:
    """(status, body, headers) of a POST; a connection that fails counts as a server that is unavailable."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return answer.status, answer.read(), dict(answer.headers)
    except urllib.error.HTTPError as error:
        return error.code, error.read(), dict(error.headers or {})
    except OSError:
        return 503, b"", {}


@dataclass(frozen=True)
class Box:
    """An area in degrees and the time from which on reports are wanted."""

    south: float
    west: float
    north: float
    east: float
    since: dt.datetime

    @staticmethod
    def of(area: str, since: dt.datetime) -> Box:
        """From `lat_min,lon_min,lat_max,lon_max`."""
        parts = area.split(",")
        if len(parts) != 4:
            raise ValueError(f"area {area!r} isn't lat_min,lon_min,lat_max,lon_max")
        south, west, north, east = map(float, parts)
        return Box(south, west, north, east, since)

    @property
    def empty(self) -> bool:
        return self.south > self.north or self.west > self.east

    def narrowed(self, column: str, kind: type, value: object) -> Box:
        """The box under a further bound on a column; strict bounds count as closed ones, which a residual filter mends."""
        if value is None:
            return self
        low, high = kind in (GreaterThan, GreaterThanOrEqual, EqualTo), kind in (LessThan, LessThanOrEqual, EqualTo)
        south, west, north, east, since = self.south, self.west, self.north, self.east, self.since
        if column == "latitude":
            south, north = (max(south, float(value)) if low else south), (min(north, float(value)) if high else north)
        elif column == "longitude":
            west, east = (max(west, float(value)) if low else west), (min(east, float(value)) if high else east)
        elif column == "at" and low:
            since = max(since, value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc))
        return Box(south, west, north, east, since)

    def request(self) -> bytes:
        """The body of a request: a closed ring of [longitude, latitude] and the start of time."""
        corners = ((self.west, self.south), (self.east, self.south), (self.east, self.north), (self.west, self.north), (self.west, self.south))
        return json.dumps({"geometry": {"type": "Polygon", "coordinates": [[list(c) for c in corners]]}, "fromTime": self.since.isoformat()}).encode()


@dataclass
class Stripe(InputPartition):
    """A part of the box between two longitudes; the last one holds its eastern edge."""

    box: Box
    last: bool
    first: bool


class VesselSource(DataSource):
    """Batch source `lantern_vessels`.

    Options: url, token_url, client_id, client_secret, area (`lat_min,lon_min,lat_max,lon_max`), since
    (ISO time; an hour ago), stripes (requests side by side; 4), timeout (30 seconds).
    """

    @classmethod
    def name(cls) -> str:
        return "lantern_vessels"

    def schema(self) -> str:
        return VESSEL

    def reader(self, schema: StructType) -> DataSourceReader:
        return VesselReader(dict(self.options))


class VesselReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        given = options.get("since")
        since = dt.datetime.fromisoformat(given) if given else dt.datetime.now(dt.timezone.utc) - dt.timedelta(hours=1)
        self.box = Box.of(options["area"], since if since.tzinfo else since.replace(tzinfo=dt.timezone.utc))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and len(one.attribute) == 1:
                self.box = self.box.narrowed(one.attribute[0], type(one), one.value)
            yield one

    def partitions(self) -> Sequence[Stripe]:
        box, n = self.box, int(self.options.get("stripes", 4))
        if box.empty:
            return []
        edges = [box.west + (box.east - box.west) * i / n for i in range(n)] + [box.east]
        return [Stripe(Box(box.south, a, box.north, b, box.since), i == n - 1, i == 0) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def _token(self) -> str:
        o = self.options
        form = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": o["client_id"], "client_secret": o["client_secret"]}).encode()
        body = fetch_with_retries(lambda: post(o["token_url"], form, {"Content-Type": "application/x-www-form-urlencoded"}, float(o.get("timeout", 30)))[:2], lambda: None)
        return json.loads(body)["access_token"]

    def read(self, partition: Stripe | None) -> Iterator[tuple]:
        if partition is None:  # what a plan without partitions is read with
            return
        o, held = self.options, {"token": self._token()}
        headers = lambda: {"Authorization": f"Bearer {held['token']}", "Content-Type": "application/json"}
        ask = lambda: post(o["url"], partition.box.request(), headers(), float(o.get("timeout", 30)))[:2]
        body = fetch_with_retries(ask, lambda: held.update(token=self._token()), sleep=lambda s: time.sleep(s * float(o.get("backoff", 1))))
        found = json.loads(body or b"[]")
        for report in found if isinstance(found, list) else found.get("results") or []:
            row = _vessel_row(report)
            east = row[3] is not None and row[3] >= partition.box.east and not partition.last
            # A report on the edge of two stripes, or without a place, belongs to one of them.
            if not east and (row[3] is not None or partition.first):
                yield row


def _vessel_row(report: dict) -> tuple:
    first = lambda *names: next((report[n] for n in names if report.get(n) is not None), None)
    number = lambda x: None if x is None else float(x)
    at = first("msgtime", "timestamp")
    try:
        when = None if at is None else dt.datetime.fromisoformat(str(at).replace("Z", "+00:00"))
    except ValueError:
        when = None
    when = when.replace(tzinfo=dt.timezone.utc) if when is not None and when.tzinfo is None else when
    mmsi = first("mmsi")
    return json.dumps(report, ensure_ascii=False), None if mmsi is None else str(mmsi), number(first("latitude", "lat")), number(first("longitude", "lon")), when


class ToolSession:
    """A session of JSON-RPC calls to a tool server."""

    def __init__(self, url: str, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.url, self.timeout, self.sleep, self.id, self.session = url, timeout, sleep, 0, ""
        self.session = self._call("initialize", {"protocolVersion": "2025-03-26", "capabilities": {}, "clientInfo": {"name": "lantern", "version": "1.0"}}).get("sessionId") or self.session

    def _call(self, method: str, params: dict) -> dict:
        self.id += 1
        body = json.dumps({"jsonrpc": "2.0", "method": method, "params": params, "id": self.id}).encode()
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream", **({"Mcp-Session-Id": self.session} if self.session else {})}

        def ask() -> tuple[int, bytes]:
            status, answer, found = post(self.url, body, headers, self.timeout)
            self.session = self.session or {k.lower(): v for k, v in found.items()}.get("mcp-session-id", "")
            return status, answer

        answer = fetch_with_retries(ask, lambda: None, self.sleep).decode()
        if answer.lstrip().startswith(("event:", "data:")):  # one event with the answer as its data
            answer = "".join(line.removeprefix("data:").strip() for line in answer.splitlines() if line.startswith("data:"))
        found = json.loads(answer)
        if "error" in found:
            raise OSError(f"{method}: {found['error']}")
        return found.get("result") or {}

    def tool(self, name: str, arguments: dict) -> dict:
        """What a tool answers: the JSON in the text of its first content; {} where there is none."""
        content = self._call("tools/call", {"name": name, "arguments": arguments}).get("content") or []
        try:
            found = json.loads(content[0]["text"]) if content and content[0].get("type") == "text" else {}
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}


@dataclass
class Slice(InputPartition):
    ids: list[str]


class ToolMailSource(DataSource):
    """Batch source `lantern_tool_mail`: the messages (JSON) that a query finds.

    Options: url, query (`newer_than:7d`), most (messages listed; 50), slice (messages a task; 10), timeout (30 seconds).
    """

    @classmethod
    def name(cls) -> str:
        return "lantern_tool_mail"

    def schema(self) -> str:
        return TOOL_MAIL

    def reader(self, schema: StructType) -> DataSourceReader:
        return ToolMailReader(dict(self.options))


class ToolMailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _session(self) -> ToolSession:
        pause = float(self.options.get("backoff", 1))
        return ToolSession(self.options["url"], float(self.options.get("timeout", 30)), lambda s: time.sleep(s * pause))

    def partitions(self) -> Sequence[Slice]:
        o = self.options
        found = self._session().tool("list_messages", {"query": o.get("query", "newer_than:7d"), "maxResults": int(o.get("most", 50))})
        ids = [str(m["id"]) for m in found.get("messages") or [] if m.get("id")]
        size = int(o.get("slice", 10))
        return [Slice(ids[i : i + size]) for i in range(0, len(ids), size)]

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        if partition is None:
            return
        session = self._session()
        for id in partition.ids:
            message = session.tool("get_message", {"messageId": id, "format": "full", "metadataHeaders": ["Subject", "Date", "From"]})
            yield str(message.get("id") or id), json.dumps(message, ensure_ascii=False)


def tool_messages(mails: DataFrame, now=None) -> DataFrame:
    """(id, headers, snippet, received_at, body) of messages from `lantern_tool_mail`, as `mappers.api_mail_items` takes them.

    The time is that of the Date header, or `now` (the current time) where there is none that can be read.
    """
    get = lambda path: F.get_json_object("message", path)
    headers = F.coalesce(F.from_json(get("$.payload.headers"), "array<struct<name: string, value: string>>"), F.array().cast("array<struct<name: string, value: string>>"))
    date = F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == "date"), F.lit(1))["value"]
    return mails.select("id", headers.alias("headers"), get("$.snippet").alias("snippet"), F.coalesce(mail_time(date), F.current_timestamp() if now is None else now).alias("received_at"), F.coalesce(T.mail_text(get("$.payload")), F.lit("")).alias("body"))


def mail_time(value):
    """The time that a mail's Date header tells, in UTC; null if it can't be read. Names of days and comments are passed over."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), r"^\s*[A-Za-z]{3},\s*", ""))
    zone = F.regexp_replace(plain, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    zone = F.regexp_replace(zone, r"\s+-0000$", " +0000")
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm xx")))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VesselSource, ToolMailSource):
        spark.dataSource.register(source)

