"""Alerts as a stateful stream: each key fires once in its time to live."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lantern.functions import identity

FIRED = "dedupe_id string, item_id string, cnr_tier string, fired_at long"


def claims(stream: DataFrame, ttl: int = 86_400_000_000, late: str = "10 minutes") -> DataFrame:
    """The attempts (item_id, cnr_tier, fired_at in microseconds) of a stream that fire.

    The state of a key is the time it fired last, and goes when the watermark, `late` behind the
    newest attempt, has passed its time to live. Attempts of one micro-batch count in their order of
    time; an attempt is dropped while the last fire is younger than `ttl`.
    """

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("fired_at", kind="stable")
        fires = []
        for at in rows["fired_at"]:
            fire = last is None or last <= at - ttl
            last = int(at) if fire else last
            fires.append(fire)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() * 1000 + 1_000_000) // 1000)
        yield rows.loc[fires, ["dedupe_id", "item_id", "cnr_tier", "fired_at"]]

    keyed = stream.filter("cnr_tier = 'I'").withColumn("dedupe_id", identity.alert_id(F.col("item_id"), F.col("cnr_tier")))
    timed = keyed.withColumn("at", F.timestamp_micros("fired_at")).withWatermark("at", late)
    return timed.groupBy("dedupe_id").applyInPandasWithState(update, FIRED, "fired_at long", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(stream: DataFrame, tiers: tuple[tuple[int, int], ...] = ((60_000_000, 5), (600_000_000, 10)), late: str = "10 minutes") -> DataFrame:
    """Fired alerts (seq, fired_at in microseconds) with `delivered`, under caps of so many in a time for all of them together.

    The cap is global, so there is one key; its state is the delivered alerts of the longest time.
    Alerts of one micro-batch count in their order of time, then seq.
    """
    longest = max(span for span, _ in tiers)

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["fired_at", "seq"], kind="stable")
        delivered = []
        for now in rows["fired_at"].tolist():
            held = [t for t in held if t > now - longest]
            fits = all(sum(t > now - span for t in held) + 1 <= most for span, most in tiers)
            held += [now] if fits else []
            delivered.append(fits)
        state.update((held,))
        state.setTimeoutTimestamp(max(max(held, default=0) + longest, state.getCurrentWatermarkMs() * 1000 + 1_000_000) // 1000)
        yield rows.assign(delivered=delivered)[["seq", "fired_at", "delivered"]]

    timed = stream.withColumn("all", F.lit(0)).withColumn("at", F.timestamp_micros("fired_at")).withWatermark("at", late)
    return timed.groupBy("all").applyInPandasWithState(update, "seq long, fired_at long, delivered boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
