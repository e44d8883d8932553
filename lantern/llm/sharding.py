"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard of the tree draws an exponential variate from a hash of (document, shard), with the
shard's weight as its rate. A rack's draw is the least of its shards' draws and a region's the
least of its racks', so an inner node draws at the rate of the summed weights below it. A document
descends from the root to the child with the least draw, level by level.

When weights change, the draws of all other subtrees stay as they are: a document either keeps its
path or moves into the subtree that grew, down to the very shard. One more shard therefore takes
documents only into itself, the law `key`.

Only built-in column functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import shared

#: Hexadecimal digits of a hash that make up a draw: 52 bits, which a double holds exactly.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """Shards in order, `shards_per_rack` to a rack and `racks_per_region` to a region.

    The last rack and region may be partly filled; a further shard goes there or opens new ones.
    `weights` holds one positive weight a shard (1 where it is shorter).
    """

    shards: int = 40
    shards_per_rack: int = 5
    racks_per_region: int = 2
    weights: Sequence[float] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if min(self.shards, self.shards_per_rack, self.racks_per_region) < 1:
            raise ValueError("a tree needs at least one shard, rack and region")
        if any(not w > 0 for w in self.weights):
            raise ValueError("weights must be positive")

    @property
    def racks(self) -> int:
        return math.ceil(self.shards / self.shards_per_rack)

    @property
    def regions(self) -> int:
        return math.ceil(self.racks / self.racks_per_region)

    def weight(self, shard: int) -> float:
        return float(self.weights[shard]) if shard < len(self.weights) else 1.0

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard."""
        weights = [self.weight(s) for s in range(self.shards)] + [weight]
        return Tree(self.shards + 1, self.shards_per_rack, self.racks_per_region, tuple(weights))


def shard_draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate with rate `weight`, fixed by the key and the shard's number."""
    bits = shared.hex_long(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DRAW_DIGITS)
    return -F.ln((bits + 0.5) / F.lit(float(16**DRAW_DIGITS))) / F.lit(weight)


def _least(draws: Column, start: Column | int, count: int) -> Column:
    return F.array_min(F.slice(draws, start, count))


def _first_of_least(draws: Column) -> Column:
    """0-based place of the least draw; the earlier one wins a tie."""
    return F.array_position(draws, F.array_min(draws)).cast("int") - 1


def _descend(df: DataFrame, tree: Tree, draws: str, prefix: str) -> DataFrame:
    """Add `{prefix}region`, `{prefix}rack` and `{prefix}shard`, reading shard draws from `draws`."""
    per_rack, per_region = tree.shards_per_rack, tree.racks_per_region
    racks, regions = f"_{prefix}racks", f"_{prefix}regions"
    region, rack, shard = (f"{prefix}{level}" for level in ("region", "rack", "shard"))
    df = df.withColumn(racks, F.array(*[_least(F.col(draws), r * per_rack + 1, per_rack) for r in range(tree.racks)]))
    df = df.withColumn(regions, F.array(*[_least(F.col(racks), r * per_region + 1, per_region) for r in range(tree.regions)]))
    df = df.withColumn(region, _first_of_least(F.col(regions)))
    in_region = F.slice(F.col(racks), F.col(region) * per_region + 1, F.lit(per_region))
    df = df.withColumn(rack, F.col(region) * per_region + _first_of_least(in_region))
    in_rack = F.slice(F.col(draws), F.col(rack) * per_rack + 1, F.lit(per_rack))
    return df.withColumn(shard, F.col(rack) * per_rack + _first_of_least(in_rack)).drop(racks, regions)


def assign(df: DataFrame, key: Column, tree: Tree, draws: str = "_draws") -> DataFrame:
    """Add `region`, `rack`, `shard` for `tree`, and `grown_shard` for the tree with one more shard."""
    grown = tree.grown()
    df = df.withColumn("_key", key)
    df = df.withColumn(draws, F.array(*[shard_draw(F.col("_key"), s, grown.weight(s)) for s in range(grown.shards)]))
    df = _descend(df.withColumn("_now", F.slice(draws, 1, tree.shards)), tree, "_now", "")
    df = _descend(df, grown, draws, "_grown_").withColumnRenamed("_grown_shard", "grown_shard")
    return df.drop("_key", "_now", draws, "_grown_region", "_grown_rack")


def shard_documents(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """Shard and slot of every row of `docs` (doc_id, text; further columns are ignored).

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ('key'), shard, slot
    (gapless from 0 within the shard), grown_shard (with one more shard), region, rack.

    A null text has no bytes: size 16, checksum 0. A null doc_id has the key ''. Rows that share a
    doc_id share a shard and get slots of their own. An empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.md5(key).alias("_digest"),
        key.alias("_text_key"),
    )
    placed = shared.staged(assign(narrow, F.col("_text_key"), tree).drop("_text_key"), "shards")
    slots = shared.running_sum(placed, "shard", shared.digest_chunk("_digest", placed.count()), ["_digest", "doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(shared.table(spark, sf_dir, "documents"))


def oracle(tree: Tree = Tree()) -> str:
    """DuckDB SQL for `shard_documents`: a flat race among all shards, and CRC-32 from its polynomial."""
    grown = tree.grown()

    def race(t: Tree) -> str:
        weights = ", ".join(f"{t.weight(s)!r}" for s in range(t.shards))
        return f"list_transform(range({t.shards}), lambda s: -ln((('0x' || substr(md5(k || ':' || s), 1, {DRAW_DIGITS}))::BIGINT + 0.5) / {float(16**DRAW_DIGITS)!r}) / [{weights}][s + 1])"

    return f"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256)) AS n)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(coalesce(text, '')) AS h FROM documents
), r AS (
  SELECT doc_id, k, length(h) // 2 + 16 AS size,
    xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
    {race(tree)} AS now, {race(grown)} AS later
  FROM d, crc
), s AS (
  SELECT *, list_position(now, list_min(now)) - 1 AS shard, list_position(later, list_min(later)) - 1 AS grown_shard FROM r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard,
  (shard // {tree.shards_per_rack * tree.racks_per_region})::INTEGER AS region, (shard // {tree.shards_per_rack})::INTEGER AS rack
FROM s"""
