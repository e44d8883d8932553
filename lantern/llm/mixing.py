"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Each source's target is its share of the wanted tokens by weight, stopped at `max_repeats`
   times the source's own size; what exceeds that is shared again by weight (water filling).
2. Each source's tokens are cut into blocks of `block_tokens`, the last one being what is left. The
   blocks of the mix go to the sources with the highest quotients t / (2 k + 1), k being the blocks a
   source has so far and t its target in blocks. No source gets more than `max_repeats` times its own.
3. Blocks of all sources, in source order, are dealt to the shards in turn: that fixes an integer
   quota for each source and shard, balanced to one block either way.
4. Each source's documents are put in an order seeded by a hash, and that stream of tokens is cut
   into blocks. The shards take their quotas one after another, each as a run of consecutive blocks
   that goes on from the stream's start when it is at its end (the stream is shuffled already, so a
   run is a random sample of documents and cuts few of them).

No block is walked one by one: a document's share of a shard is the overlap of intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import shared


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order, repeating
    share_percent: int = 150  # wanted tokens, in percent of all
    max_repeats: int = 2
    block_tokens: int = 16
    shards: int = 8
    seed: str = "mix"


def source_targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """Add `ordinal`, `weight` and `target` to (source, source_size), one row a source, null last.

    The windows here run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    rows = totals.withColumn("ordinal", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(weights, (F.col("ordinal") % len(mix.weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * mix.max_repeats)
    # Sources reach their caps in the order of cap / weight; the water level is found from there.
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "ordinal")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    wanted = F.sum("source_size").over(all_rows) * mix.share_percent / 100.0
    rows = rows.withColumn(
        "_level",
        (wanted - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / F.sum("weight").over(onward),
    )
    # The first level that its own source does not reach is the greatest of those.
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))).over(all_rows)
    rows = rows.withColumn("_water", level)
    filled = F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_water"))
    return rows.withColumn("target", F.coalesce(filled, F.col("_cap").cast("double"))).drop("_cap", "_level", "_water")


def block_quotas(targets: DataFrame, mix: Mix) -> DataFrame:
    """Add `blocks` (the source's own), `quota` (blocks it gives) by Sainte-Laguë, and `first_block` (quotas before the source's).

    With n sources and K blocks in targets that sum to T, a divisor of T / (K - n / 2) gives away at
    most K blocks and one of T / (K + n / 2) at least K. Between them lie about 2 n quotients; the
    highest of those get the blocks that are left.
    """
    whole = Window.partitionBy()
    rows = targets.withColumn("blocks", F.ceil(F.col("source_size") / mix.block_tokens))
    rows = rows.withColumn("_most", F.col("blocks") * mix.max_repeats)
    in_blocks = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_b", in_blocks).withColumn("_t", F.sum("_b").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_k", F.round("_t").cast("long"))
    seats = lambda blocks: F.least(F.col("_most"), F.coalesce(F.floor(F.col("_b") * F.greatest(blocks, F.lit(0.0)) / F.col("_t") + 0.5), F.lit(0)))
    rows = rows.withColumn("_low", seats(F.col("_k") - F.col("_n") / 2)).withColumn("_high", seats(F.col("_k") + F.col("_n")))
    rows = rows.withColumn("_left", F.col("_k") - F.sum("_low").over(whole))
    bids = rows.filter("_high > _low").select("ordinal", "_b", "_left", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    by_quotient = Window.orderBy((F.col("_b") / (2 * F.col("_seat") + 1)).desc(), "ordinal")
    won = bids.withColumn("_rank", F.row_number().over(by_quotient)).filter("_rank <= _left").groupBy("ordinal").agg(F.count(F.lit(1)).alias("_won"))
    rows = rows.join(won, "ordinal", "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first_block", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    return rows.drop("_b", "_t", "_n", "_k", "_most", "_low", "_high", "_left", "_won")


def shard_quotas(quotas: DataFrame, mix: Mix) -> DataFrame:
    """Integer quota of every source and shard: (source, shard, blocks), blocks dealt in turn."""
    shard = F.explode(F.sequence(F.lit(0), F.lit(mix.shards - 1)))
    upto = lambda n: F.floor((n - F.col("shard") + mix.shards - 1) / mix.shards)
    rows = quotas.select("source", "quota", "first_block", shard.alias("shard"))
    return rows.select("source", "shard", (upto(F.col("first_block") + F.col("quota")) - upto(F.col("first_block"))).alias("blocks"))


def shard_ranges(quotas: DataFrame, mix: Mix) -> DataFrame:
    """(source, ranges): for each shard, the blocks from `low` to before `high` of the source's repeated stream.

    The window runs over one row per source and shard.
    """
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = shard_quotas(quotas, mix).withColumn("low", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    ranges = F.struct("shard", "low", (F.col("low") + F.col("blocks")).alias("high"))
    return rows.groupBy("source").agg(F.sort_array(F.collect_list(ranges)).alias("ranges"))


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def _digest(doc_id: Column, mix: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _overlap(start, end, low, high):
    return F.greatest(F.least(end, high) - F.greatest(start, low), F.lit(0))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What the mix takes of every row of `docs` (doc_id, source, text; further columns are ignored).

    Returns doc_id, size (words), source_size, target, taken (words, repeats counted), source,
    quota (blocks of the source).

    A null or empty text has no words and gives none. A null source is a source of its own, last
    in order. Rows that share a doc_id count as documents of their own. An empty table gives an
    empty result.
    """
    return mix_sizes(docs.select("doc_id", "source", _words(F.col("text")).alias("size")), mix)


def mix_sizes(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`mix_documents` from (doc_id, source, size in tokens)."""
    taken = F.aggregate("shares", F.lit(0).cast("long"), lambda total, s: total + s["taken"])
    return _shared_out(sizes, mix).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "quota")


def mix_shards(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What each shard takes of every row of `docs`: doc_id, size, source, shard, taken (words), none of them 0.

    The sum over the shards is what `mix_documents` gives. Without repeats no word is in two shards.
    """
    rows = _shared_out(docs.select("doc_id", "source", _words(F.col("text")).alias("size")), mix)
    return rows.select("doc_id", "size", "source", F.explode("shares").alias("s")).filter("s.taken > 0").select("doc_id", "size", "source", "s.shard", "s.taken")


def _placed(sizes: DataFrame, mix: Mix) -> DataFrame:
    """The rows (doc_id, source, size and others) with their source's facts and `_at`, the words before them in its stream."""
    rows = shared.staged(sizes.withColumn("_digest", _digest(F.col("doc_id"), mix)), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = shared.staged(block_quotas(source_targets(totals, mix), mix), "mix-quotas")
    ranges = shard_ranges(quotas, mix).withColumnRenamed("source", "_source")
    facts = quotas.join(ranges, F.col("source").eqNullSafe(F.col("_source")))
    facts = shared.staged(facts.select("_source", "ordinal", "source_size", "target", "quota", "blocks", "ranges"), "mix-ranges")
    order = ["_digest", "doc_id", "size", *[c for c in sizes.columns if c not in ("doc_id", "source", "size")]]
    chunk = shared.digest_chunk("_digest", rows.count())
    rows = rows.join(shared.small(facts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return shared.running_sum(rows, "ordinal", chunk, order, F.col("size"), "_at")


def _shared_out(sizes: DataFrame, mix: Mix) -> DataFrame:
    """The rows with their source's facts and `shares` (shard, taken), one for each shard."""
    block, whole = F.lit(mix.block_tokens), F.greatest("blocks", F.lit(1))
    start, end = F.col("_at"), F.col("_at") + F.col("size")

    def upto(blocks):  # words of the document in so many blocks of the repeated stream
        return F.floor(blocks / whole) * F.col("size") + _overlap(start, end, F.lit(0), blocks % whole * block)

    shares = F.transform("ranges", lambda r: F.struct(r["shard"].alias("shard"), (upto(r["high"]) - upto(r["low"])).cast("long").alias("taken")))
    return _placed(sizes, mix).withColumn("shares", shares)


def take_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of `docs` (doc_id, source, text and any others), each as often as the mix takes its words, to the nearest whole copy.

    A source's documents are all taken as often as its stream is passed through, and those before a
    cut in its seeded order once more; the document at the cut is, if half of it or more is. Texts
    aren't moved: the cuts, one row a source, are compared with each row's place in the order.
    Documents without words aren't taken. Rows that agree in doc_id, source and text are taken
    alike. All columns are carried along, whatever their names. An empty table stays empty.
    """
    narrow = docs.select("doc_id", "source", _words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    placed = _placed(narrow, mix)
    passes = F.floor(F.col("quota") / F.greatest("blocks", F.lit(1)))
    rest = F.col("quota") % F.greatest("blocks", F.lit(1)) * mix.block_tokens  # words of the last pass
    more = _overlap(F.col("_at"), F.col("_at") + F.col("size"), F.lit(0), rest) * 2 >= F.col("size")
    place = F.struct("_digest", "doc_id", "size", "text_key")
    cuts = placed.filter("size > 0").groupBy("source", passes.cast("int").alias("_passes")).agg(F.max(F.when(more, place)).alias("_cut"))
    cuts = shared.small(shared.staged(cuts.withColumnRenamed("source", "_source"), "mix-cuts"))
    row = shared.packed(docs).withColumn("_words", _words(F.col("_row.text"))).filter("_words > 0")
    row = row.join(cuts, F.col("_row.source").eqNullSafe(F.col("_source")))
    own = F.struct(_digest(F.col("_row.doc_id"), mix).alias("_digest"), F.col("_row.doc_id").alias("doc_id"), F.col("_words").alias("size"), F.xxhash64("_row.text").alias("text_key"))
    copies = F.col("_passes") + F.when(own <= F.col("_cut"), 1).otherwise(0)
    return row.withColumn("_copies", copies).filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(shared.table(spark, sf_dir, "documents"))


def oracle(mix: Mix = Mix()) -> str:
    """DuckDB SQL for `mix_documents`: blocks are apportioned one by one instead of by divisor bounds."""
    weights, b = list(mix.weights), mix.block_tokens
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{shared.WORD}')), 0) AS size,
    md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    {weights}[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1)::INTEGER] AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS ordinal
  FROM d GROUP BY source
), levels AS (
  SELECT *, {mix.max_repeats} * source_size AS cap,
    (sum(source_size) OVER () * {mix.share_percent} / 100.0
      - coalesce(sum({mix.max_repeats} * source_size) OVER (ORDER BY {mix.max_repeats} * source_size / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY {mix.max_repeats} * source_size / w, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT *, coalesce(least(cap::DOUBLE, w * (SELECT max(level) FROM levels WHERE level <= cap / w)), cap::DOUBLE) AS target FROM levels
), u AS (
  SELECT *, ceil(source_size / {b})::BIGINT AS blocks, CASE WHEN source_size > 0 THEN target * ceil(source_size / {b}) / source_size ELSE 0 END AS tb FROM t
), seats AS (
  SELECT ordinal, row_number() OVER (ORDER BY tb / (2 * k + 1) DESC, ordinal) AS place
  FROM u, LATERAL (SELECT unnest(range({mix.max_repeats} * blocks)) AS k)
), won AS (
  SELECT ordinal, count(*) AS n FROM seats WHERE place <= (SELECT round(sum(tb)) FROM u) GROUP BY ordinal
), q AS (
  SELECT u.*, coalesce(n, 0) AS quota FROM u LEFT JOIN won USING (ordinal)
), p AS (
  SELECT d.*, q.source_size, q.target, q.quota, q.blocks,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN blocks = 0 THEN 0 ELSE
    (quota // blocks) * size + greatest(least(a + size, (quota % blocks) * {b}) - a, 0)
  END)::BIGINT AS taken, source, quota::BIGINT AS quota
FROM p"""
