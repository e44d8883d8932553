"""Sources, sinks, streams, scalar functions and store rules on small fixtures."""

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lantern.functions import identity, models, names, places, verdict
from lantern.functions import text as T
from lantern.operators import aggregates, bus, entities, folds, store, views
from lantern.plans import derive, taxonomy
from lantern.sinks import files as sinks
from lantern.sources import files, mappers, remote
from lantern.streaming import alerts as alert_stream
from lantern.streaming import bus as bus_stream

SF = "/root/testdata/sf0.001"


def values(spark, kind, cells, column):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, "string", ["https://a.b/Foo_(bar).", "https://a.b/x).", "https://a.b/?!"], T.trim_url) == ["https://a.b/Foo_(bar)", "https://a.b/x", "https://a.b/"]
    assert values(spark, "string", ["NATO's", "GitHub Actions", "  United   States ", "Russ", "Støre (Ap)", "НАТО"], names.normalize_name) == ["nato", "github action", "united state", "ru", "støre ap", "нато"]
    assert values(spark, "string", ["cw.no", "GitHub", "Black", "Oslo"], names.is_noise) == [True, True, True, False]
    assert values(spark, "string", ["НАТО", "Зеленский", "Щит"], T.latin_key) == ["nato", "zelenskiy", "schit"]
    assert values(spark, "string", ["⚠ Blåbær på øy\nto", "Жук", None], T.ascii_header) == ["! Blabaer pa oy", "???", ""]
    assert values(spark, "string", ["&lt;![CDATA[<p>Hi &amp; ho</p>]]&gt; Stikkord: null", None], T.html_to_text) == ["Hi & ho", ""]
    assert values(spark, "string", ["aGVsbG8", "aGk_", "*"], T.base64url_text)[:1] == ["hello"]
    assert values(spark, "string", [" ", " ", "a", None], T.blank_to_null) == [None, None, "a", None]
    assert values(spark, "string", ["a, ,b ,", None], T.comma_list) == [["a", "b"], []]
    assert values(spark, "string", ["a<think>b</think>c"], T.strip_thinking) == ["ac"]
    assert values(spark, "string", ["å/b c*~"], identity.percent_encoded) == ["%C3%A5%2Fb%20c%2A~"]
    assert values(spark, "string", ["Hello, World!", "---", "x" * 40], T.tail_slug) == ["hello-world", "untitled", "x" * 32]
    assert values(spark, "string", ['<a href="x">&\'</a>'], T.escape_xml) == ["&lt;a href=&quot;x&quot;&gt;&amp;&apos;&lt;/a&gt;"]


def test_verdict_functions(spark):
    assert values(spark, "string", ["7", "12", "-3", "7.9", "x", None], verdict.clamp_score) == [7, 10, 0, 0, 0, 0]
    raw = ['{"ccir": "PIR-1", "cnr": "I", "score": 3, "why": "w"}', '```json\n{"ccir": "none", "pmesii": "Military"}\n```', 'So: {"ccir": "PIR-2", "score": "8"} ok', "garbage", "[1]", '{"ccir": "PIR-3", "score": 99, "tessoc": "Terror"}', ""]
    got = values(spark, "string", raw, verdict.salvage)
    assert [(v.ccir, v.cnr, v.pmesii, v.tessoc, v.score, v.bucket) for v in got] == [
        ("PIR-1", "I", "none", "none", 3, "read"), ("none", "none", "none", "none", 0, "skip"), ("PIR-2", "none", "none", "none", 8, "read"),
        ("none", "none", "none", "none", 0, "skip"), ("none", "none", "none", "none", 0, "skip"), ("PIR-3", "none", "none", "Terror", 10, "read"), ("none", "none", "none", "none", 0, "skip"),
    ]
    assert got[3].why == verdict.UNREADABLE
    lists = ['```json\n[{"name": "NATO", "type": "ORG"}, {"name": "nato", "type": "LOC"}, {"name": " ", "type": "ORG"}, {"name": "Oslo", "type": "CITY"}]\n```', "none", "[]", "[1, 2]"]
    assert [[(e.name, e.type) for e in v] for v in values(spark, "string", lists, verdict.entities)] == [[("NATO", "ORG"), ("Oslo", "MISC")], [], [], []]


def test_places_and_times(spark):
    assert places.area_ring("74,15,81,35")[0][0] == [15.0, 74.0] and places.area_ring("74,15,81,35")[0][2] == [35.0, 81.0]
    with pytest.raises(ValueError):
        places.parse_area("1,2,3")
    assert places.parse_lookback("7D") == dt.timedelta(days=7)
    with pytest.raises(ValueError):
        places.parse_lookback("7w")
    now = dt.datetime(2026, 1, 8, tzinfo=dt.timezone.utc)
    assert places.parse_since("7d", now).day == 1 and places.parse_since("2026-01-01", now).tzinfo is not None
    rows = [("200", "<?xml version='1'?><rss/>"), ("200", "﻿<feed/>"), ("200", "<html>about <rss></html>"), ("301", ""), ("403", ""), ("429", ""), ("503", ""), ("err", ""), ("x", ""), ("200", "text")]
    frame = spark.createDataFrame(rows, "s string, b string").select(places.feed_status(F.col("s"), F.col("b")).alias("y"))
    assert [r.y for r in frame.collect()] == ["ok", "ok", "warn", "warn", "warn", "transient", "bad", "bad", "bad", "warn"]


def test_identity(spark):
    frame = spark.createDataFrame([("rss", "u", "t"), ("rss", None, "t")], "a string, b string, c string")
    got = [r.y for r in frame.select(identity.item_id(F.col("a"), F.col("b"), F.col("c")).alias("y")).collect()]
    assert got == [hashlib.sha256(b"rss\0u\0t").hexdigest(), hashlib.sha256(b"rss\0\0t").hexdigest()]
    assert values(spark, "string", ["a.b c-1"], lambda c: identity.note_link(c, "My vault", "out"))[0] == "obsidian://open?vault=My%20vault&file=out%2Fabc-1.md"


def test_views_and_taxonomy(spark):
    rows = [("1", "PIR-3", "military", "none", 5), ("2", "pir-1", "Military ", "Terror", None), ("3", None, None, None, 9), ("4", "SIR-2", "Political", "", 1), ("5", "PIR-1", "Social", "Terror", 8)]
    items = spark.createDataFrame(rows, "item_id string, ccir string, pmesii string, tessoc string, score int")
    ids = lambda f: sorted(r.item_id for r in f.collect())
    assert ids(views.view(items, "COP")) == ["1"] and ids(views.view(items, "cip")) == ["2"] and ids(views.view(items, None)) == list("12345")
    assert ids(views.crp(items, {"ccir": " Pir-1 ", "min_score": "8"})) == ["5"] and ids(views.crp(items, {"min_score": "many"})) == list("12345")
    assert ids(views.kept(items)) == ["1", "2", "4", "5"]
    with pytest.raises(ValueError):
        views.view(items, "other")
    assert taxonomy.COP_IDS == ("PIR-3", "FFIR-1", "FFIR-2", "FFIR-3", "FFIR-4") and taxonomy.kind("FFIR-1") == "ffir"
    with pytest.raises(KeyError):
        taxonomy.requirement("PIR-99")
    assert "PIR-1" in taxonomy.quick_reference() and taxonomy.id_enum().endswith("|none")


def test_store_rules(spark):
    writes = [("a", "en", 1, [1.0], "N"), ("a", "en", 2, None, "M"), ("a", "en", 3, [], "O")]
    frame = spark.createDataFrame(writes, "name_norm string, lang string, seq long, embedding array<float>, name string")
    row = store.upserted_entities(frame).first()
    assert (row.name, row.embedding) == ("O", [1.0])
    links = spark.createDataFrame([(1, "i", "m", "no", 2), (1, "i", "m", "en", 1)], "entity_id long, item_id string, mention string, lang string, seq long")
    assert store.inserted_links(links).first().lang == "en"
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "data binary")
    assert store.distinct_blobs(blobs).count() == 2


def test_bus_rules(spark):
    death = json.dumps([{"exchange": "news", "routing-keys": ["verdict.ready"]}])
    rows = [(1, "dead", "i", "{}", death), (2, "dead", "j", "not json", None), (3, "dead", "k", "{}", death)]
    letters = spark.createDataFrame(rows, bus_stream.MESSAGE)
    again, dropped = bus.replayed(letters, 2)
    assert [(r.offset, r.routing_key) for r in again.collect()] == [(1, "verdict.ready")] and [r.offset for r in dropped.collect()] == [2]
    reports = spark.createDataFrame([("u", "n", "x" * 120, 1), ("u", "n", "x" * 121, 1), ("u", "n", None, 1)], "feed_url string, feed_name string, reason string, ts long")
    good, bad = bus.unhealthy(reports)
    assert good.count() == 1 and bad.count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"offset": 1, "routing_key": "verdict.ready", "item_id": "a", "body": "{}"}, {"offset": 2, "routing_key": "verdict.ready", "item_id": "a", "body": "{}"}, {"offset": 3, "routing_key": "item.ingested", "item_id": "a", "body": "{}"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = bus_stream.published_once(bus_stream.messages(spark, str(source)))
    for q in bus_stream.fan_out(stream, str(tmp_path / "out"), str(tmp_path / "ck")).values():
        q.awaitTermination()
    count = lambda q: sum(len(f.read_text().splitlines()) for f in (tmp_path / "out" / q).glob("*.json"))
    assert [count(q) for q in ("q.brief", "q.wiki", "q.alerting", "q.triage", "q.ops")] == [1, 1, 1, 1, 0]


def streamed(spark, folder, parts, ddl):
    """A stream of the parts, a micro-batch each."""
    (folder / "in").mkdir()
    names = [c.split()[0] for c in ddl.split(", ")]
    for n, part in enumerate(parts):
        (folder / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part))
        os.utime(folder / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder / "in"))


def collected(spark, stream, folder, name):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_alert_stream(spark, tmp_path):
    t = 1_700_000_000_000_000
    rows = [("a", "I", t), ("a", "I", t + 10), ("a", "II", t + 20), ("b", "I", t + 5), ("a", "I", t + 100)]
    stream = streamed(spark, tmp_path, (rows[:2], rows[2:]), "item_id string, cnr_tier string, fired_at long")
    fired = collected(spark, alert_stream.claims(stream, ttl=100), tmp_path, "fired")
    assert sorted((r.item_id, r.fired_at - t) for r in fired) == [("a", 0), ("a", 100), ("b", 5)]


def test_throttle_stream_equals_the_fold(spark, tmp_path):
    t, second = 1_700_000_000_000_000, 1_000_000
    times = [0, 1, 2, 3, 4, 5, 59, 60, 61, 100, 200, 300, 301, 302, 303, 304, 599, 600, 601, 1300, 1301]
    rows = [(i, t + s * second) for i, s in enumerate(times)]
    stream = streamed(spark, tmp_path, (rows[:7], rows[7:15], rows[15:]), "seq long, fired_at long")
    got = {r.seq: r.delivered for r in collected(spark, alert_stream.throttled(stream), tmp_path, "throttled")}
    fold = {r.seq: r.tier is None for r in folds.throttle_alerts(spark.createDataFrame(rows, "seq long, fired_at long")).collect()}
    assert got == fold and 0 < sum(fold.values()) < len(rows)


def test_bounded_stream_of_messages_and_items(spark, tmp_path):
    stream = streamed(spark, tmp_path, [[("a.b", "1"), ("a.b", "1")], [("a.b", "1"), ("a.c", "2")]], "routing_key string, item_id string")
    timed = stream.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    items = spark.createDataFrame([("1", "x")], "item_id string, title string")
    rows = collected(spark, bus_stream.with_items(bus_stream.published_once(timed, "at"), items), tmp_path, "found")
    assert sorted((r.routing_key, r.item_id, r.title, r.found) for r in rows) == [("a.b", "1", "x", True), ("a.c", "2", None, False)]


def test_item_stream_scores_only_what_passes(spark, tmp_path):
    vector = lambda t: [1.0, 0.0] if "good" in t else [0.0, 1.0]
    seen = []
    items = spark.createDataFrame([("i1", 100, "good news", "s"), ("i2", 200, "good copy", "s"), ("i3", 300, "bad", "s")], "item_id string, t long, title string, summary string").withColumn("ts", F.timestamp_seconds("t"))
    targets = spark.createDataFrame([("PIR-1", [1.0, 0.0])], "ccir_id string, embedding array<float>")
    known = items.select("item_id", F.col("ts").alias("created_at"), F.lit(None).cast("array<float>").alias("embedding")).limit(0)
    rows = bus_stream.scored(items, targets, known, models.embedder(vector), models.scorer(lambda p: '{"ccir": "PIR-1", "score": 9}'))
    got = {r.item_id: (r.verdict.ccir, r.verdict.why) for r in rows.collect()}
    assert got == {"i1": ("PIR-1", None), "i2": ("none", "duplicate of i1"), "i3": ("none", "below prefilter")}
    assert json.loads(bus_stream.verdict_events(rows).filter("item_id = 'i1'").first().body)["bucket"] == "keep"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"item_id": "x", "source_type": "rss"}\n{"item_id": "y", "source_type": "fax"}')
    stream = spark.readStream.schema("item_id string, source_type string, discipline string").json(str(tmp_path / "in"))
    bus_stream.run_items(stream, lambda d, n: seen.extend(r.item_id for r in d.collect()), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert seen == ["x"] and spark.read.json(str(tmp_path / "bad")).first().item_id == "y"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\nurl: http://x\ndate: 2026-01-02T03:04:05Z\nlang: en\n---\nBody æ\n")
    (tmp_path / "b.md").write_text("---\nnot closed\n")
    clips = files.markdown_clips(spark, str(tmp_path))
    items = {r.title: r for r in mappers.clip_items(clips, F.timestamp_seconds(F.lit(0))).collect()}
    assert items["T"].url == "http://x" and items["T"].lang == "en" and items["T"].ts.year == 2026 and items["T"].body.strip() == "Body æ"
    assert items["b"].url == "obsidian://b" and items["b"].ts.year == 1970 and "not closed" in items["b"].body
    (tmp_path / "s.opml").write_text('<opml><body><outline text="News"><outline text="Sub"><outline type="rss" title="A" xmlUrl="http://a"/></outline></outline><outline type="rss" title="Loose" xmlUrl="http://l"/></body></opml>')
    assert [tuple(r) for r in files.subscriptions(spark, str(tmp_path / "s.opml")).collect()] == [("News", "A", "http://a")]
    (tmp_path / "v.jsonl").write_text('{"t": 5, "source": "a"}\nbroken\n{"t": 10, "source": "b"}\n')
    assert [r.source for r in files.verdict_log(spark, str(tmp_path / "v.jsonl"), 6).collect()] == ["b"]
    blob = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / blob).write_bytes(b"x")
    (tmp_path / "blobs" / ("0" * 64)).write_bytes(b"x")
    assert [r.hash for r in files.blobs(spark, str(tmp_path / "blobs")).collect()] == [blob]
    text = "- **PIR-1** war\n  and front\n- ~~SIR-2 gone~~\n  old\n## Next\n- PIR-2: ice"
    assert files.requirement_texts(text) == {"PIR-1": "war and front", "PIR-2": "ice"}


def test_remote_sources(spark, tmp_path):
    raw = b"From: a@b\r\nSubject: =?utf-8?q?Bl=C3=A5?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHei  der"

    class Imap:
        def select(self, box, readonly):
            assert readonly

        def uid(self, command, *rest):
            return ("OK", [b"1 2 3"]) if command == "SEARCH" else ("OK", [(b"x", raw), b")"])

    class Pop3:
        def uidl(self):
            return b"+OK", [b"1 aa", b"2 bb"], 0

        def retr(self, n):
            return b"+OK", raw.split(b"\r\n"), 0

    now = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = list(remote.read_imap(Imap(), "h", "INBOX", "ALL", now, newest=2)) + list(remote.read_pop3(Pop3(), "h", now))
    assert [r[3] for r in rows] == ["2", "3", "aa", "bb"]
    items = mappers.mail_items(spark.createDataFrame(rows, remote.MAIL)).collect()
    assert {(i.title, i.summary) for i in items} == {("Blå", "Hei der")}
    assert remote.imap_search(None, 2, dt.date(2026, 1, 3)) == "(SINCE 01-Jan-2026)"
    entries = {"items": [{"id": 2, "title": " ", "html": "<p>x</p>", "created_on_time": 5}, {"id": 1, "title": "old"}, {"id": 3, "title": "T", "url": "http://u"}]}
    (tmp_path / "e.json").write_text(json.dumps(entries))
    spark.dataSource.register(remote.FeedApiSource)
    stream = spark.readStream.format("lantern_feed_api").option("url", f"file://{tmp_path}/e.json").load()
    q = stream.writeStream.format("memory").queryName("entries").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = mappers.feed_items(spark.sql("SELECT * FROM entries")).orderBy("id").collect()
    finally:
        q.stop()
    assert [(i.id, i.title, i.url) for i in got] == [(1, "old", "fever://item/1"), (2, "(untitled)", "fever://item/2"), (3, "T", "http://u")]
    answers, waits = iter([(401, b""), (503, b""), (503, b""), (200, b"ok")]), []
    assert remote.fetch_with_retries(lambda: next(answers), lambda: None, waits.append) == b"ok" and waits == [2.0, 4.0]
    probed = remote.probed(spark.createDataFrame([(f"file://{tmp_path}/e.json",), (f"file://{tmp_path}/none",)], "url string")).collect()
    assert [r.status for r in probed] == ["200", "err"]
    assert remote.service_status("503", "") == ("degraded", "503") and remote.licensed("true") and not remote.licensed(None)


def test_sinks(spark, tmp_path):
    items = derive.enriched(spark, SF)
    members = folds.greedy_keywords(views.kept(items).withColumn("words", T.keywords("title")))
    written = sinks.write_digests(tmp_path, items, members, lambda title, best: f"{title}: {len(best)}")
    assert len(written) == 12 and all((tmp_path / n).read_text().startswith("# ") for n in written)
    strict = (tmp_path / "list.md").read_text().count("- **[")
    assert strict == items.filter("score >= 8").count()
    assert sinks.write_notes(tmp_path / "notes", items.limit(20)) == len(list((tmp_path / "notes").glob("*.md")))
    assert sinks.atom_feed(items, "f", 3).count("<entry>") == 3
    feeds = spark.createDataFrame([("c", "B", "http://b", "ok"), ("c", "a", "http://a", "transient"), ("d", "x", "http://x", "bad")], "category string, title string, url string, status string")
    text = sinks.working_subscriptions(feeds)
    assert text.index("http://a") < text.index("http://b") and "http://x" not in text
    assert sinks.merged_page("---\na: 1\nb: 2\n---\nold", {"b": "3"}, "new") == "---\na: 1\nb: 3\n---\nnew"
    tries = []

    def send(payload):
        tries.append(payload["id"])
        if payload["id"] == 1 or len(tries) < 3:
            raise OSError

    assert [o for _, o in sinks.deliver([{"id": 0}, {"id": 1}], send, lambda s: None)] == ["delivered", "dlx"] and tries == [0, 0, 0, 1, 1, 1]


def test_reports(spark):
    feeds = spark.createDataFrame([("c", "ok"), ("c", "warn"), ("d", "bad")], "category string, status string")
    assert {(r.category, r.ok, r.warn, r.bad) for r in aggregates.feed_counts(feeds).collect()} == {("c", 1, 1, 0), ("d", 0, 0, 1)}
    services = spark.createDataFrame([("a", "up"), ("b", "down")], "name string, status string")
    assert aggregates.service_state(services).first().state == "degraded"
    mentions = spark.createDataFrame([("en", "NATO"), ("ru", "НАТО"), ("en", "Oslo")], "lang string, mention string")
    assert [(r.left, r.right) for r in entities.cross_script_pairs(mentions).collect()] == [("NATO", "НАТО")]
    graph = spark.createDataFrame([("i", [("N", "n", "en", None)]), ("j", [("N", "m", None, "ORG")])], "item_id string, entities array<struct<name:string,mention:string,lang:string,type:string>>")
    row = entities.graph_notes(graph).first()
    assert (row.name, row.aliases, row.n_items, row.type) == ("N", ["m (?)", "n (en)"], 2, "MISC")
    assert models.mean_pooled([[3.0, 0.0], [9.0, 9.0]], [1, 0]) == [1.0, 0.0]
