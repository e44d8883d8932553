"""Alerts: gate, windows, payloads and digests. The recursive parts are in `folds`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import identity, text
from lantern.operators import ordering


def urgent(items: DataFrame) -> DataFrame:
    """Only the first tier alerts."""
    return items.filter("cnr = 'I'")


def sliding_counts(events: DataFrame, spans: tuple[int, ...] = (60, 600)) -> DataFrame:
    """Add `last_<span>s`: events in the seconds up to each event, itself included, the far end excluded.

    `events` has seq and fired_at (microseconds). Time is cut into pieces of the longest span and
    each event also goes to the next piece, so that a window never needs more than one piece and no
    task sees all events. Events of one instant all count.
    """
    piece = max(spans) * 1_000_000
    own = F.expr(f"fired_at div {piece}")
    rows = events.withColumn("_own", own).withColumn("_piece", F.explode(F.array(own, own + 1)))
    for span in spans:
        window = Window.partitionBy("_piece").orderBy("fired_at").rangeBetween(-span * 1_000_000 + 1, 0)
        rows = rows.withColumn(f"last_{span}s", F.count(F.lit(1)).over(window))
    return rows.filter("_own = _piece").drop("_own", "_piece")


def payloads(items: DataFrame, vault: str = "obsidian", brief_url: str = "") -> DataFrame:
    """The seven fields of an alert for each item."""
    return items.select(
        identity.alert_id(F.col("item_id"), F.col("cnr")).alias("alert_id"), "item_id", F.col("cnr").alias("cnr_tier"),
        F.left(F.coalesce(F.nullif("why", F.lit("")), "summary", F.lit("")), F.lit(500)).alias("excerpt"),
        text.comma_list("pmesii").alias("pmesii_tags"), identity.note_link(F.col("item_id"), vault).alias("note_link"),
        F.lit(brief_url).alias("brief_link"),
    )


def primary_domain(column):
    """The first part of a comma list, or `Unclassified`."""
    return F.coalesce(F.try_element_at(text.comma_list(column), F.lit(1)), F.lit("Unclassified"))


def digest_groups(state: DataFrame) -> DataFrame:
    """(domain, n, first_at, items) of alerts that are suppressed and not digested yet, items by time."""
    rows = state.filter("suppressed and digested_at is null").withColumn("domain", primary_domain("pmesii"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("fired_at").alias("first_at"), F.transform(F.array_sort(F.collect_list(F.struct("fired_at", "item_id"))), lambda s: s["item_id"]).alias("items"))


def undigested(state: DataFrame) -> DataFrame:
    """The alerts that are suppressed and not digested yet, in the digest's order: domain, nulls last, then time.

    `place` numbers them from 0. The rows stay rows, however many there are; `digest_groups` is for a digest that one message holds.
    """
    rows = state.filter("suppressed and digested_at is null")
    return ordering.numbered(rows, [], [F.col("pmesii").asc_nulls_last(), F.col("fired_at").asc(), F.col("seq").asc()], "place")


def mark_digested(state: DataFrame, sent: DataFrame, at) -> DataFrame:
    """The state after a digest of the alerts in `sent` (dedupe_id)."""
    hit = sent.select("dedupe_id", F.lit(True).alias("_sent")).distinct()
    rows = state.join(hit, "dedupe_id", "left")
    return rows.withColumn("digested_at", F.when(F.col("_sent"), at).otherwise(F.col("digested_at"))).drop("_sent")


def with_outcomes(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The state after deliveries: `outcomes` has dedupe_id, outcome (delivered or dlx) and at; others raise."""
    checked = F.when(F.col("outcome").isin("delivered", "dlx"), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("invalid outcome: "), F.coalesce("outcome", F.lit("null")))))
    last = outcomes.withColumn("outcome", checked).groupBy("dedupe_id").pivot("outcome", ["delivered", "dlx"]).agg(F.max("at"))
    rows = state.join(last, "dedupe_id", "left")
    return rows.withColumn("delivered_at", F.coalesce("delivered", "delivered_at")).withColumn("dlx_at", F.coalesce("dlx", "dlx_at")).drop("delivered", "dlx")


def dispatched(events: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """Add `handler` to messages (body: JSON) by the body's `event`; unknown events and unreadable bodies are acknowledged (`ack`)."""
    event = F.get_json_object("body", "$.event")
    handler = F.create_map(*[F.lit(x) for pair in handlers.items() for x in pair])[event]
    return events.withColumn("event", event).withColumn("handler", F.coalesce(handler, F.lit("ack")))
