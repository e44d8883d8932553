"""Streams with timers: error counters, the hourly digest, delivery that is tried again.

Each is a processor of `transformWithStateInPandas`: state of a key in the RocksDB store, and timers
that fire without input. What a sink reports (delivered, failed) comes back as input, so that state
changes only after it has happened: an alert stays in the digest's state until a digest with it was
delivered, and an alert that can't be delivered is tried again when its timer says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000
#: Milliseconds before the second and the third attempt to deliver, and how long an alert's state is kept at most.
WAITS, KEPT = (1000, 5000), 7 * 24 * HOUR


def prepare(spark: SparkSession) -> None:
    """Timers and state with a time to live need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list:
    rows = list(batches)
    return list(pd.concat(rows).sort_values(order, kind="stable").itertuples(index=False)) if rows else []


class ErrorCounter(StatefulProcessor):
    """Per queue, the failures in a row; at `most` of them it speaks, and begins anew."""

    OUT = _schema(queue=StringType(), seq=LongType())

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", _schema(n=LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        reached = []
        for row in _rows(rows, ["seq"]):
            n = 0 if row.ok else n + 1
            if n == self.most:
                reached.append((key[0], row.seq))
                n = 0
        self.count.update((n,))
        if reached:
            yield pd.DataFrame(reached, columns=["queue", "seq"])

    def close(self) -> None:
        pass


def error_bursts(results: DataFrame, most: int = 10) -> DataFrame:
    """(queue, seq) at which `most` failures in a row were reached, from a stream of (queue, seq, ok)."""
    return results.groupBy("queue").transformWithStateInPandas(ErrorCounter(most), ErrorCounter.OUT, "Append", "None")


class DigestTick(StatefulProcessor):
    """Per channel, the suppressed alerts that no delivered digest has told yet; a digest of all of them at each tick."""

    OUT = _schema(channel=StringType(), tick=LongType(), dedupe_id=StringType(), body=StringType())

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _schema(dedupe_id=StringType()), _schema(body=StringType()))
        self.next = handle.getValueState("next", _schema(at=LongType()))

    def _wind(self, now: int) -> None:
        at = (now // self.every + 1) * self.every
        self.next.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for row in _rows(rows, ["seq"]):
            if row.kind == "suppressed":
                self.held.updateValue((row.dedupe_id,), (row.body,))
            elif row.kind == "delivered" and self.held.containsKey((row.dedupe_id,)):
                self.held.removeKey((row.dedupe_id,))
        if not self.next.exists():
            self._wind(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        told = sorted((k[0], v[0]) for k, v in self.held.iterator())
        if told:
            self._wind(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame([(key[0], at, *t) for t in told], columns=["channel", "tick", "dedupe_id", "body"])
        else:
            self.next.clear()  # the next alert winds the clock again

    def close(self) -> None:
        pass


def digest_ticks(alerts: DataFrame, every: int = HOUR) -> DataFrame:
    """(channel, tick, dedupe_id, body): what the digest of each tick holds.

    `alerts` is a stream of (channel, seq, kind, dedupe_id, body): `suppressed` alerts come in, and
    `delivered` ones go. An alert is in every digest until it is told to be delivered, so a
    digest that fails is repeated whole with the next one.
    """
    return alerts.groupBy("channel").transformWithStateInPandas(DigestTick(every), DigestTick.OUT, "Append", "ProcessingTime")


class Delivery(StatefulProcessor):
    """Per alert, what is to be sent and how often it was tried; a timer for the next attempt."""

    OUT = _schema(dedupe_id=StringType(), action=StringType(), attempt=LongType(), body=StringType(), reason=StringType())

    def __init__(self, waits: tuple[int, ...]) -> None:
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _schema(body=StringType(), attempt=LongType(), ended=LongType()), KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        body, attempt, ended = self.state.get() if self.state.exists() else (None, 0, 0)
        out = []
        for row in _rows(rows, ["seq"]):
            if row.kind == "alert" and not attempt:
                body, attempt = row.body, 1
                out.append((key[0], "send", 1, body, None))
            elif row.kind in ("delivered", "failed") and attempt and not ended:
                if row.kind == "delivered":
                    ended = 1
                    out.append((key[0], "delivered", attempt, body, None))
                elif attempt <= len(self.waits):
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.waits[attempt - 1])
                else:
                    ended = 1
                    out.append((key[0], "dead", attempt, body, row.body))
        if attempt:
            self.state.update((body, attempt, ended))
        if out:
            yield pd.DataFrame(out, columns=self.OUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        body, attempt, ended = self.state.get()
        if not ended:
            self.state.update((body, attempt + 1, ended))
            yield pd.DataFrame([(key[0], "send", attempt + 1, body, None)], columns=self.OUT.fieldNames())

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, waits: tuple[int, ...] = WAITS) -> DataFrame:
    """(dedupe_id, action, attempt, body, reason): what is to be done for each alert.

    `events` is a stream of (dedupe_id, seq, kind, body): an `alert` with its payload, and `delivered` or
    `failed` (body: the reason) as the sender reports. Actions are `send`, again after the waits, then
    `delivered` or `dead`. An alert that comes again is not sent again while its state is kept.
    """
    return events.groupBy("dedupe_id").transformWithStateInPandas(Delivery(waits), Delivery.OUT, "Append", "ProcessingTime")


def dead_letters(actions: DataFrame) -> DataFrame:
    """(routing_key, item_id, body): messages for the dead-letter queue, the payload with reason and attempts."""
    told = F.udf(_with_reason, StringType())
    return actions.filter("action = 'dead'").select(F.lit("outbox.dlx").alias("routing_key"), F.col("dedupe_id").alias("item_id"), told("body", "reason", "attempt").alias("body"))


def _with_reason(body: str | None, reason: str | None, attempt: int) -> str:
    try:
        payload = json.loads(body or "{}")
    except ValueError:
        payload = {"raw": body}
    return json.dumps({**(payload if isinstance(payload, dict) else {"raw": payload}), "reason": reason, "attempts": attempt}, ensure_ascii=False)
