"""Message streams: publication once, fan-out, dead letters, and the item pipeline in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lantern.functions import text as T
from lantern.functions import verdict
from lantern.operators import bus, store, vectors

MESSAGE = "offset long, routing_key string, item_id string, body string, x_death string"


def messages(spark: SparkSession, folder: str, per_trigger: int = 10) -> DataFrame:
    """A stream of JSON messages from a folder, so many files a trigger."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).json(folder)


def published_once(stream: DataFrame, time: str | None = None, within: str = "7 days") -> DataFrame:
    """Messages without those whose routing key and item were seen before; the state is durable.

    With a `time` column, keys are forgotten after `within`, so that the state stays bounded;
    without one, they never are.
    """
    key = ["routing_key", "item_id"]
    return stream.dropDuplicates(key) if time is None else stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def with_items(stream: DataFrame, items: DataFrame) -> DataFrame:
    """Messages with the stored item that they name (`found`: whether there is one); `items` has item_id.

    A join of a stream with a static table: the message that misses is kept, so that it can be acknowledged.
    """
    return stream.join(items.withColumn("found", F.lit(True)), "item_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def fan_out(stream: DataFrame, folder: str, checkpoints: str) -> dict[str, StreamingQuery]:
    """A query for each queue, with a checkpoint of its own, that writes its messages below `folder`."""
    queues = {q for bound in bus.ROUTES.values() for q in bound}
    routed = bus.delivered(stream)
    start = lambda q: routed.filter(F.col("queue") == q).writeStream.format("json").option("checkpointLocation", f"{checkpoints}/{q}").trigger(availableNow=True).start(f"{folder}/{q}")
    return {q: start(q) for q in sorted(queues)}


def scored(items: DataFrame, targets: DataFrame, known: DataFrame, embed: Callable[[Column], Column], answer: Callable[[Column], Column], prefilter: float = vectors.PREFILTER, duplicate: float = vectors.DUPLICATE) -> DataFrame:
    """The verdict of new items: cheap gates first, the model last.

    `items` has item_id, ts, title, summary; `known` has item_id, created_at and embedding of earlier
    ones. Items below the prefilter or close to an earlier one get a fixed verdict, and only the
    others reach the scoring model. Returns the items with embedding, verdict and duplicate_of.
    """
    text = F.left(T.clean_for_embedding(F.concat_ws(" ", "title", "summary")), F.lit(512))
    rows = vectors.prefilter(items.withColumn("embedding", embed(text)).withColumn("created_at", F.col("ts")), targets, prefilter)
    every = rows.select("item_id", "created_at", "embedding").unionByName(known.select("item_id", "created_at", "embedding"))
    nearest = vectors.near_earlier(every.filter("embedding is not null"), duplicate).select("item_id", "duplicate_of")
    rows = rows.join(nearest, "item_id", "left")
    fixed = lambda why: F.struct(*[F.lit("none").alias(n) for n in ("ccir", "cnr", "pmesii", "tessoc")], F.lit(0).alias("score"), why.alias("why"), F.lit("skip").alias("bucket"))
    open_ = rows.filter(F.col("passes") & F.col("duplicate_of").isNull())
    asked = open_.withColumn("verdict", verdict.salvage(answer(F.concat_ws("\n", "title", "summary"))))
    closed = rows.filter(~(F.col("passes") & F.col("duplicate_of").isNull()))
    why = F.when(~F.col("passes"), F.lit("below prefilter")).otherwise(F.concat(F.lit("duplicate of "), "duplicate_of"))
    return asked.unionByName(closed.withColumn("verdict", fixed(why)))


def verdict_events(rows: DataFrame) -> DataFrame:
    """Messages `verdict.ready` of scored items, in the vocabulary of events."""
    body = F.to_json(F.struct(F.lit("verdict.ready").alias("event"), "item_id", F.col("verdict.ccir").alias("ccir"), verdict.event_cnr(F.col("verdict.cnr")).alias("cnr"), F.col("verdict.score").alias("score"), verdict.event_bucket(F.col("verdict.bucket")).alias("bucket"), F.col("verdict.why").alias("why")))
    return rows.select(F.lit("verdict.ready").alias("routing_key"), "item_id", body.alias("body"))


def run_items(stream: DataFrame, handle: Callable[[DataFrame, int], None], quarantine: str, checkpoint: str) -> StreamingQuery:
    """Admit each micro-batch and hand it over; rejected rows go to `quarantine`.

    The batch's number makes the writes repeatable: a batch that runs again overwrites its own files.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        good, bad = store.admitted(rows)
        bad.write.mode("overwrite").json(f"{quarantine}/batch={number}")
        handle(good, number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
