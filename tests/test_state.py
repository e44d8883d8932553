"""Streams with timers, batches in steps, leases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lantern.streaming import lease, ledger, state


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of JSON rows, and how to add to it."""
    state.prepare(spark)
    count = iter(range(10**6))

    def start(ddl):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)

        def add(*rows):
            n = next(count)
            (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
            (tmp_path / f"{n}.json").rename(folder / f"{n}.json")

        return spark.readStream.schema(ddl).json(str(folder)), add

    return start


def running(stream, tmp_path, name):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(processingTime="300 milliseconds").start()


def until(spark, name, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.table(name).collect()
        if done(rows):
            return rows
        time.sleep(0.3)
    raise AssertionError(f"{name}: {spark.table(name).collect()}")


def test_errors_in_a_row(spark, feed, tmp_path):
    stream, add = feed("queue string, seq long, ok boolean")
    query = running(state.error_bursts(stream, 3), tmp_path, "bursts")
    try:
        add(*[{"queue": "q", "seq": i, "ok": i == 1} for i in range(4)], {"queue": "p", "seq": 1, "ok": False})
        add(*[{"queue": "q", "seq": i, "ok": False} for i in (4, 5, 6, 7)])
        rows = until(spark, "bursts", lambda rows: len(rows) >= 2)
        assert sorted((r.queue, r.seq) for r in rows) == [("q", 4), ("q", 7)]
    finally:
        query.stop()


def test_a_digest_repeats_until_it_is_delivered(spark, feed, tmp_path):
    stream, add = feed("channel string, seq long, kind string, dedupe_id string, body string")
    query = running(state.digest_ticks(stream, 2000), tmp_path, "digests")
    try:
        add(*[{"channel": "c", "seq": i, "kind": "suppressed", "dedupe_id": f"d{i}", "body": f"b{i}"} for i in range(3)])
        first = until(spark, "digests", lambda rows: len({r.tick for r in rows}) >= 2)  # nobody says that the first was delivered
        ticks = sorted({r.tick for r in first})
        assert all(t % 2000 == 0 for t in ticks) and {(r.dedupe_id, r.body) for r in first if r.tick == ticks[0]} == {(f"d{i}", f"b{i}") for i in range(3)}
        add(*[{"channel": "c", "seq": 9, "kind": "delivered", "dedupe_id": d} for d in ("d0", "d2")])
        told = lambda rows, tick: {r.dedupe_id for r in rows if r.tick == tick}
        until(spark, "digests", lambda rows: told(rows, max(r.tick for r in rows)) == {"d1"})
        add({"channel": "c", "seq": 10, "kind": "delivered", "dedupe_id": "d1"})
        end, n = time.time() + 40, -1
        while time.time() < end and n != (n := spark.table("digests").count()):  # until two ticks go by without a digest
            time.sleep(5)
        assert time.time() < end
    finally:
        query.stop()


def test_delivery_is_tried_three_times(spark, feed, tmp_path):
    stream, add = feed("dedupe_id string, seq long, kind string, body string")
    actions = state.deliveries(stream, (500, 1000))
    query = running(actions, tmp_path, "sent")
    sends = lambda rows, d: [r.attempt for r in rows if r.dedupe_id == d and r.action == "send"]
    try:
        add({"dedupe_id": "a", "seq": 1, "kind": "alert", "body": '{"x": 1}'}, {"dedupe_id": "b", "seq": 1, "kind": "alert", "body": "{}"}, {"dedupe_id": "a", "seq": 2, "kind": "alert", "body": "again"})
        until(spark, "sent", lambda rows: sends(rows, "a") == [1] and sends(rows, "b") == [1])
        add({"dedupe_id": "a", "seq": 3, "kind": "failed", "body": "HTTP 503"}, {"dedupe_id": "b", "seq": 3, "kind": "delivered"})
        until(spark, "sent", lambda rows: sends(rows, "a") == [1, 2])
        add({"dedupe_id": "a", "seq": 4, "kind": "failed", "body": "HTTP 503"})
        until(spark, "sent", lambda rows: sends(rows, "a") == [1, 2, 3])
        add({"dedupe_id": "a", "seq": 5, "kind": "failed", "body": "HTTP 500"}, {"dedupe_id": "b", "seq": 6, "kind": "alert", "body": "late"})
        rows = until(spark, "sent", lambda rows: any(r.action == "dead" for r in rows))
        assert sorted((r.dedupe_id, r.action, r.attempt) for r in rows if r.action != "send") == [("a", "dead", 3), ("b", "delivered", 1)]
        dead = state.dead_letters(spark.table("sent")).collect()
        assert [(r.routing_key, r.item_id, json.loads(r.body)) for r in dead] == [("outbox.dlx", "a", {"x": 1, "reason": "HTTP 500", "attempts": 3})]
        assert sends(spark.table("sent").collect(), "b") == [1]
    finally:
        query.stop()


class Stopped(BaseException):
    """What a killed driver looks like to the code that runs."""


def test_a_batch_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{n}", n) for n in range(20)], "item_id string, n int")
    log, held = [], ledger.Ledger(str(tmp_path / "ledger"))
    state_ = {"stop": True}

    def enrich(df, batch):
        log.append("enrich")
        return df.withColumn("score", F.col("n") * 2)

    def publish(df, batch):
        log.append("publish")
        if state_.pop("stop", False):
            raise Stopped
        df.write.mode("overwrite").json(str(tmp_path / f"out-{batch}"))

    steps = [ledger.Step("enrich", enrich), ledger.Step("publish", publish)]
    with pytest.raises(Stopped):
        ledger.run_batch(rows, 7, steps, held, str(tmp_path / "bad"))
    # The source gives other rows now; the batch is still what it was.
    assert ledger.run_batch(rows.filter("n < 5"), 7, steps, held, str(tmp_path / "bad")) == ["publish"]
    assert log == ["enrich", "publish", "publish"]
    assert spark.read.json(str(tmp_path / "out-7")).agg(F.sum("score")).first()[0] == 380
    assert ledger.run_batch(rows, 7, steps, held, str(tmp_path / "bad")) == []
    assert ledger.run_batch(rows, 8, steps, held, str(tmp_path / "bad")) == ["enrich", "publish"]
    with pytest.raises(ValueError, match="names"):
        ledger.run_batch(rows, 9, steps + steps, held, str(tmp_path / "bad"))


def test_rows_that_fail_go_to_quarantine_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{n}", n) for n in range(40)], "item_id string, n int")

    @F.udf("int")
    def check(n):
        if n in (13, 31):
            raise ValueError(f"bad row {n}")
        return n + 1

    steps = [ledger.Step("score", lambda df, b: df.withColumn("m", check("n"))), ledger.Step("names", lambda df, b: 1 / 0, best_effort=True), ledger.Step("last", lambda df, b: None)]
    held = ledger.Ledger(str(tmp_path / "ledger"))
    assert ledger.run_batch(rows, 0, steps, held, str(tmp_path / "bad")) == ["score", "names", "last"]
    assert sorted(r.n for r in held.rows(0, "last", rows).collect()) == [n for n in range(40) if n not in (13, 31)]
    bad = spark.read.json(str(tmp_path / "bad" / "batch=000000000" / "score")).collect()
    assert sorted((r.item_id, r._step) for r in bad) == [("i13", "score"), ("i31", "score")] and all("bad row" in r._error for r in bad)


def test_the_stream_of_steps(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"item_id": f"i{n}"}) for n in range(6)))
    stream = spark.readStream.schema("item_id string").json(str(folder))
    steps = [ledger.Step("count", lambda df, b: df.withColumn("batch", F.lit(b)))]
    for _ in range(2):
        query = ledger.run_steps(stream, steps, str(tmp_path / "ledger"), str(tmp_path / "bad"), str(tmp_path / "ck"))
        query.awaitTermination(60)
        assert query.exception() is None
    assert ledger.Ledger(str(tmp_path / "ledger")).rows(0, "count", spark.range(1)).count() == 6


def test_one_run_at_a_time(spark, tmp_path):
    now = [1000.0]
    runs = lease.Leases(spark, f"file://{tmp_path}/lease", 60, lambda: now[0])
    first = runs.acquire()
    with pytest.raises(lease.Refused, match="held"):
        lease.Leases(spark, f"file://{tmp_path}/lease", 60, lambda: now[0]).acquire()
    now[0] += 50
    first.renew()
    now[0] += 50
    assert runs.live() == first.number == 1
    now[0] += 20  # silent for 70 seconds
    second = runs.acquire()
    assert second.number == 2
    for late in (first.renew, lambda: runs.fence(first.number)):
        with pytest.raises(lease.Refused):
            late()
    first.release()  # too late to free what isn't its own
    assert runs.live() == 2
    runs.fence(second.number)
    with second:
        pass
    assert runs.live() is None
    with runs.acquire() as third:
        assert third.number == 3


def test_two_runs_that_start_together(spark, tmp_path):
    runs = lease.Leases(spark, f"file://{tmp_path}/lease")
    runs._newest = lambda: 0  # both have looked before either wrote
    runs.acquire()
    with pytest.raises(lease.Refused, match="another run"):
        runs.live = lambda: None
        runs.acquire()
