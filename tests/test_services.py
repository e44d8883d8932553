"""Sources behind services, against stand-in servers: what is asked for, what comes back, what is tried again."""

import base64
import datetime as dt
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lantern.sources import mappers, services

UTC = dt.timezone.utc


class Server:
    """A server whose answers a function gives: (path, body, headers) to (status, body[, headers])."""

    def __init__(self, answer):
        self.calls, lock, outer = [], threading.Lock(), self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"] or 0))
                with lock:
                    outer.calls.append((self.path, body, dict(self.headers)))
                    status, out, *more = answer(self.path, body, dict(self.headers))
                self.send_response(status)
                for k, v in (more[0] if more else {}).items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def serve():
    servers = []

    def start(answer):
        servers.append(Server(answer))
        return servers[-1]

    yield start
    for s in servers:
        s.server.shutdown()


SHIPS = [{"mmsi": 257000000 + i, "name": f"Ship {i}", "latitude": 58 + i % 12, "longitude": 4 + (i * 7 % 25), "msgtime": f"2024-05-0{1 + i % 8}T10:00:00+00:00", "speedOverGround": i / 2} for i in range(60)]


def vessel_answers(state):
    def answer(path, body, headers):
        if path == "/token":
            form = urllib.parse.parse_qs(body.decode())
            assert form["grant_type"] == ["client_credentials"] and form["client_secret"] == ["s3"]
            state["tokens"] += 1
            return 200, json.dumps({"access_token": f"t{state['tokens']}", "expires_in": 3600}).encode()
        if state["errors"]:
            return state["errors"].pop(), b""
        if headers.get("Authorization") == "Bearer expired":
            return 401, b""
        asked = json.loads(body)
        ring = asked["geometry"]["coordinates"][0]
        assert ring[0] == ring[-1] and len(ring) == 5
        west, south, east, north = ring[0][0], ring[0][1], ring[2][0], ring[2][1]
        since = dt.datetime.fromisoformat(asked["fromTime"])
        state["boxes"].append((south, west, north, east, since))
        found = [s for s in SHIPS if south <= s["latitude"] <= north and west <= s["longitude"] <= east and dt.datetime.fromisoformat(s["msgtime"]) >= since]
        return 200, json.dumps(found if state["list"] else {"results": found}).encode()

    return answer


def vessels(spark, server, **options):
    services.register(spark)
    given = {"url": f"{server.url}/ais", "token_url": f"{server.url}/token", "client_id": "c", "client_secret": "s3", "area": "57,4,72,32", "since": "2024-05-01T00:00:00Z", "backoff": "0.01", **options}
    return spark.read.format("lantern_vessels").options(**given).load()


@pytest.mark.parametrize("as_list", [True, False])
def test_vessels_once_each_over_all_stripes(spark, serve, as_list):
    state = {"tokens": 0, "errors": [503, 429], "boxes": [], "list": as_list}
    rows = vessels(spark, serve(vessel_answers(state)), stripes=7)
    items = mappers.vessel_items(rows).collect()
    assert sorted(r.mmsi for r in items) == sorted(str(s["mmsi"]) for s in SHIPS)
    assert {r.title for r in items if r.mmsi == "257000003"} == {"AIS: Ship 3 (257000003) near Unknown"}
    assert len(state["boxes"]) == 7


def test_filters_shrink_what_is_asked_for(spark, serve):
    state = {"tokens": 0, "errors": [], "boxes": [], "list": True}
    rows = vessels(spark, serve(vessel_answers(state)), stripes=2)
    north = rows.filter((F.col("latitude") > 60) & (F.col("latitude") <= 66) & (F.col("longitude") >= 10) & (F.col("at") >= dt.datetime(2024, 5, 3, tzinfo=UTC)) & (F.col("mmsi") != "257000009"))
    got = sorted(r.mmsi for r in north.collect())
    expected = sorted(str(s["mmsi"]) for s in SHIPS if 60 < s["latitude"] <= 66 and s["longitude"] >= 10 and s["msgtime"] >= "2024-05-03" and s["mmsi"] != 257000009)
    assert got == expected and got
    assert sorted(state["boxes"]) == [(60, 10, 66, 21, dt.datetime(2024, 5, 3, tzinfo=UTC)), (60, 21, 66, 32, dt.datetime(2024, 5, 3, tzinfo=UTC))]


def test_nothing_is_asked_for_an_empty_area(spark, serve):
    state = {"tokens": 0, "errors": [], "boxes": [], "list": True}
    server = serve(vessel_answers(state))
    assert vessels(spark, server).filter("latitude < 10").collect() == []
    assert server.calls == []


def test_a_rejected_token_is_renewed_once(serve):
    state = {"tokens": 0, "errors": [], "boxes": [], "list": True}
    server = serve(lambda path, body, headers: (401, b"") if headers.get("Authorization") == "Bearer t1" else vessel_answers(state)(path, body, headers))
    reader = services.VesselReader({"url": f"{server.url}/ais", "token_url": f"{server.url}/token", "client_id": "c", "client_secret": "s3", "area": "57,4,72,32", "since": "2024-05-01T00:00:00", "stripes": "1"})
    assert len(list(reader.read(reader.partitions()[0]))) == len(SHIPS) and state["tokens"] == 2
    refused = serve(lambda path, body, headers: (200, b'{"access_token": "x"}') if path == "/token" else (401, b""))
    reader.options.update(url=f"{refused.url}/ais", token_url=f"{refused.url}/token")
    with pytest.raises(OSError, match="401"):
        list(reader.read(reader.partitions()[0]))


def test_reports_without_a_place_and_bad_areas():
    odd = services._vessel_row({"mmsi": None, "lat": "60.5", "lon": 5, "timestamp": "no time"})
    assert odd[1:] == (None, 60.5, 5.0, None)
    with pytest.raises(ValueError, match="lat_min"):
        services.Box.of("1,2,3", dt.datetime.now(UTC))


def coded(value):
    return base64.urlsafe_b64encode(value.encode()).decode().rstrip("=")


def mail(i):
    payload = {"mimeType": "text/plain", "body": {"data": coded(f"body {i} å")}}
    for _ in range(i % 9):
        payload = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/html", "body": {"data": coded("<p>")}}, payload]}
    payload["headers"] = [{"name": "Subject", "value": f"Subject {i}"}, {"name": "DATE", "value": f"Tue, {1 + i % 28} May 2024 10:00:0{i % 10} +0200 (CEST)"}, {"name": "From", "value": "a@b"}]
    return {"id": f"m{i}", "snippet": f"snip {i}", "payload": payload}


def tool_answers(state, n, events=False):
    def answer(path, body, headers):
        asked = json.loads(body)
        if state["errors"]:
            return state["errors"].pop(), b""
        if asked["method"] == "initialize":
            state["sessions"] += 1
            more = {"Mcp-Session-Id": f"s{state['sessions']}"}
            return 200, json.dumps({"jsonrpc": "2.0", "id": asked["id"], "result": {} if events else {"sessionId": f"s{state['sessions']}"}}).encode(), more
        state["used"].append(headers.get("Mcp-Session-Id"))
        arguments = asked["params"]["arguments"]
        if asked["params"]["name"] == "list_messages":
            assert arguments["query"] == "newer_than:2d"
            found = {"messages": [{"id": f"m{i}", "threadId": "t"} for i in range(min(n, arguments["maxResults"]))] + [{"threadId": "none"}]}
        else:
            assert arguments["format"] == "full"
            found = mail(int(arguments["messageId"][1:]))
        text = json.dumps({"jsonrpc": "2.0", "id": asked["id"], "result": {"content": [{"type": "text", "text": json.dumps(found)}]}})
        return 200, (f"event: message\ndata: {text}\n\n" if events else text).encode()

    return answer


@pytest.mark.parametrize("events", [False, True])
def test_mail_in_slices_of_a_session_each(spark, serve, events):
    state = {"sessions": 0, "used": [], "errors": [503]}
    server = serve(tool_answers(state, 23, events))
    services.register(spark)
    mails = spark.read.format("lantern_tool_mail").options(url=server.url, query="newer_than:2d", slice=5, backoff="0.01").load()
    assert mails.rdd.getNumPartitions() == 5
    got = services.tool_messages(mails).orderBy("id").collect()
    assert {r.id: r.body for r in got} == {f"m{i}": f"body {i} å" for i in range(23)}
    assert {r.received_at.replace(tzinfo=None) for r in got if r.id == "m3"} == {dt.datetime(2024, 5, 4, 8, 0, 3)}
    items = mappers.api_mail_items(services.tool_messages(mails)).collect()
    assert {r.title for r in items} == {f"Subject {i}" for i in range(23)} and {r.summary for r in items if r.id == "m7"} == {"snip 7"}
    assert None not in state["used"] and "" not in state["used"]


def test_errors_of_the_tool_server(spark, serve):
    failing = serve(lambda path, body, headers: (200, json.dumps({"jsonrpc": "2.0", "id": 1, "error": {"code": -1, "message": "no"}}).encode()))
    with pytest.raises(OSError, match="initialize"):
        services.ToolSession(failing.url)
    bare = serve(lambda path, body, headers: (200, json.dumps({"result": {"content": [{"type": "text", "text": "no json"}]}}).encode()))
    assert services.ToolSession(bare.url).tool("list_messages", {}) == {}
    services.register(spark)
    assert spark.read.format("lantern_tool_mail").options(url=bare.url).load().collect() == []


def test_mail_times(spark):
    now = dt.datetime(2000, 1, 1)
    values = [("Tue, 7 May 2024 10:00:00 +0200", dt.datetime(2024, 5, 7, 8)), ("07 May 2024 10:00:00 GMT", dt.datetime(2024, 5, 7, 10)), ("Tue, 7 May 2024 10:00 -0000", dt.datetime(2024, 5, 7, 10)), ("yesterday", None), (None, None)]
    frame = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(values)], "i int, v string")
    assert [r.t and r.t.replace(tzinfo=None) for r in frame.select("i", services.mail_time(F.col("v")).alias("t")).orderBy("i").collect()] == [t for _, t in values] and now
