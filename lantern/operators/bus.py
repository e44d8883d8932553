"""Messages: idempotent publication, dead letters, replay, health events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Routing keys and the queues that get them; fixed values.
ROUTES = {
    "item.ingested": ("q.triage",),
    "verdict.ready": ("q.brief", "q.wiki", "q.alerting"),
    "sab.published": ("q.notify", "q.alerting"),
    "feed.unhealthy": ("q.ops",),
}
DEATH = "array<struct<exchange:string,`routing-keys`:array<string>>>"


def published_once(messages: DataFrame) -> DataFrame:
    """The first message of each routing key and item."""
    rest = [c for c in messages.columns if c not in ("routing_key", "item_id")]
    rows = messages.groupBy("routing_key", "item_id").agg(F.min_by(F.struct(*rest), "offset").alias("f"))
    return rows.select("routing_key", "item_id", *[F.col(f"f.{c}").alias(c) for c in rest])


def delivered(messages: DataFrame) -> DataFrame:
    """Each message once for each queue that its key is bound to."""
    pairs = [F.lit(x) for key, queues in ROUTES.items() for x in (key, F.array(*[F.lit(q) for q in queues]))]
    lookup = F.create_map(*[p if hasattr(p, "_jc") or not isinstance(p, str) else F.lit(p) for p in pairs])
    return messages.withColumn("queue", F.explode(F.coalesce(F.try_element_at(lookup, F.col("routing_key")), F.array().cast("array<string>"))))


def dead_letters(messages: DataFrame) -> DataFrame:
    """Add `origin_exchange`, `origin_key` (from the first death in `x_death`, JSON) and `readable` (the body is JSON)."""
    first = F.try_element_at(F.from_json("x_death", DEATH), F.lit(1))
    key = F.try_element_at(first["routing-keys"], F.lit(1))
    return messages.withColumn("origin_exchange", first["exchange"]).withColumn("origin_key", key).withColumn("readable", F.try_parse_json("body").isNotNull())


def replayed(letters: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(messages to publish again, messages dropped) of the first `n` letters: those without a route are dropped."""
    taken = dead_letters(letters).orderBy("offset").limit(n)
    known = F.col("origin_key").isNotNull() & (F.col("origin_key") != "")
    again = taken.filter(known).select("offset", F.col("origin_key").alias("routing_key"), "body")
    return again, taken.filter(~F.coalesce(known, F.lit(False)))


def unhealthy(reports: DataFrame, longest: int = 120) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of feed reports (feed_url, feed_name, reason, ts): a reason too long is rejected."""
    ok = F.coalesce(F.length("reason") <= longest, F.lit(False))
    events = reports.filter(ok).select(F.lit("feed.unhealthy").alias("event"), "feed_url", "feed_name", "reason", "ts")
    return events, reports.filter(~ok)


def deep_queues(depths: DataFrame, most: int = 50) -> DataFrame:
    """Probes (queue, depth, ts) at or above the alarm depth, as reports of an unhealthy queue."""
    reason = F.concat(F.lit("depth "), F.col("depth").cast("string"))
    return depths.filter(F.col("depth") >= most).select(F.col("queue").alias("feed_url"), F.col("queue").alias("feed_name"), reason.alias("reason"), "ts")
