"""Entity resolution in order, settled in parallel rounds.

The rule is sequential: each name in turn takes the nearest entity made before it, or becomes an
entity that later names may take. Whether a name becomes one depends on its earlier neighbours only
(those at or above the threshold): it does if all of these took another entity. So a name is
settled as soon as its earlier neighbours are:

1. names near a known entity take one;
2. the first of the others are settled in order, a bounded number; what is near an entity made there
   takes one, which clears away crowds of like names before their pairs are listed;
3. of the rest all pairs of neighbours are found, and rounds of joins settle every name that waits for
   none, then what is near it, until no pair is left. A round settles at least the first
   name of every group that hangs together; for names in no particular order their number grows
   with the logarithm of the names;
4. every name that takes an entity is compared with those made, and with the known ones only in step 1,
   for the nearest before it, and only for one that is as near as its known one.

The result is that of the sequential rule. Names with equal vectors count as one until the last step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import names, verdict
from lantern.functions import text as T
from lantern.operators import neighbours, tiles, vectors

#: Names that are settled in order at the beginning; the only ones the driver sees.
HEAD = 1024


#: Edges that one task settles in order, of 16 bytes each.
FEW = 1_000_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The followers among the nodes of edges (later, earlier) that come by their later node."""
    following: set[int] = set()
    for batch in batches:
        names_ = batch.schema.names
        later, earlier = (batch.column(names_.index(c)).to_pylist() for c in ("later", "earlier"))
        for a, b in zip(later, earlier):
            if b not in following:
                following.add(a)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(following), pa.int64())], names=["rank"])


def settled(edges: DataFrame, log: list[int] | None = None) -> DataFrame:
    """(rank): the nodes that follow another one; `edges` has (later, earlier), checkpointed. All other nodes lead.

    A node leads unless one of its earlier neighbours does. `log` gets the number of edges before each round.
    What is left when there are no more than FEW edges is settled in order by one task.
    """
    followers = edges.select(F.col("later").alias("rank")).limit(0)
    while True:
        left = edges.count()
        if not left:
            return followers
        if left <= FEW:
            last = edges.repartition(1).sortWithinPartitions("later").mapInArrow(_in_order, "rank long")
            return neighbours.checkpointed(followers.union(last))
        if log is not None:
            log.append(left)
        waiting = edges.select(F.col("later").alias("earlier")).distinct()
        leads = edges.select("earlier").distinct().join(waiting, "earlier", "left_anti")
        new = neighbours.checkpointed(edges.join(leads, "earlier", "left_semi").select(F.col("later").alias("rank")).distinct())
        rest = edges.join(new.withColumnRenamed("rank", "later"), "later", "left_anti").join(new.withColumnRenamed("rank", "earlier"), "earlier", "left_anti")
        edges = neighbours.checkpointed(rest)
        followers = neighbours.checkpointed(followers.union(new))


def _head(rows: DataFrame, threshold: float) -> tuple[list[int], dict[int, np.ndarray], int]:
    """(ranks of the leaders, their unit vectors by length, last rank looked at) of the first HEAD rows (rank, vector)."""
    leaders: dict[int, list[np.ndarray]] = {}
    first = rows.orderBy("rank").limit(HEAD).collect()
    lead_ranks: list[int] = []
    for row in first:
        vector = np.asarray(row.vector, np.float64)
        vector = vector / np.linalg.norm(vector)
        held = leaders.setdefault(len(vector), [])
        if not held or tiles.similarity(vector[None, :], np.stack(held)).max() < threshold:
            held.append(vector)
            lead_ranks.append(row.rank)
    return lead_ranks, {dims: np.stack(v) for dims, v in leaders.items()}, first[-1].rank if first else -1


def _beyond(rows: DataFrame, leaders: dict[int, np.ndarray], last: int, threshold: float) -> DataFrame:
    """The `rows` (rank, vector) after rank `last` that are near none of the leaders."""
    @F.pandas_udf("boolean")
    def far(found: pd.Series) -> pd.Series:
        out = np.ones(len(found), bool)
        lengths = np.array([len(v) for v in found])
        for dims in set(lengths.tolist()) & set(leaders):
            places = np.flatnonzero(lengths == dims)
            matrix = np.stack([np.asarray(found.iloc[i], np.float64) for i in places])
            matrix /= np.linalg.norm(matrix, axis=1)[:, None]
            out[places] = tiles.similarity(matrix, leaders[dims]).max(axis=1) < threshold
        return pd.Series(out)

    return rows.filter((F.col("rank") > last) & far("vector"))


def _banded(rows: DataFrame, id: str, threshold: float, recall: float) -> DataFrame:
    return rows.select(F.col("rank").alias(id), F.explode(neighbours.band_keys(threshold, recall)("vector")).alias("_band"))


def _near_by_bands(later: DataFrame, earlier: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(later, earlier, similarity) of the pairs at the threshold that share a band, the earlier one having the lower rank."""
    pairs = neighbours.candidates(_banded(later, "_l_id", threshold, recall), _banded(earlier, "_e_id", threshold, recall), F.col("_e_id") < F.col("_l_id"), ["_band"])
    side = lambda rows, name, vector: rows.select(F.col("rank").alias(name), F.col("vector").alias(vector))
    met = pairs.join(side(later, "later", "_a"), "later").join(side(earlier, "earlier", "_b"), "earlier").filter(F.size("_a") == F.size("_b"))
    return met.select("later", "earlier", F.round(vectors.cosine(F.col("_a"), F.col("_b")), 9).alias("similarity")).filter(F.col("similarity") >= threshold)


def _nearest(rows: DataFrame, targets: DataFrame, threshold: float, recall: float | None) -> DataFrame:
    """(rank, target, similarity): the nearest of `targets` of lower rank; both sides have rank and vector.

    With `least`, a similarity, `rows` look for nothing below it; it is the threshold or more.
    """
    if recall is None:
        also = tuple(c for c in ("least",) if c in rows.columns)
        # Large tiles of targets have small cells; smaller ones of rows make more tasks.
        asked, held = tiles.tiles(rows, also=also, share=2), tiles.tiles(targets, spread=2)
        return tiles.nearest_before(neighbours.checkpointed(asked), neighbours.checkpointed(held), threshold)
    near = _near_by_bands(rows, targets, threshold, recall)
    return near.groupBy(F.col("later").alias("rank")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "earlier")).alias("_b")).select("rank", F.col("_b.earlier").alias("target"), (-F.col("_b.s")).alias("similarity"))


def _leaders(fresh: DataFrame, threshold: float, recall: float | None, log: list[int] | None) -> DataFrame:
    """(rank) of those of `fresh` (rank, vector; checkpointed) that become entities."""
    once = neighbours.checkpointed(fresh.groupBy("vector").agg(F.min("rank").alias("rank")).select("rank", "vector"))
    lead_ranks, held, last = _head(once, threshold)
    firsts = fresh.sparkSession.createDataFrame([(r,) for r in lead_ranks], "rank long")
    rest = neighbours.checkpointed(_beyond(once, held, last, threshold))
    if recall is None:
        edges = tiles.near_pairs(neighbours.checkpointed(tiles.tiles(rest)), threshold)
    else:
        edges = _near_by_bands(rest, rest, threshold, recall).select("later", "earlier")
    followers = settled(neighbours.checkpointed(edges), log)
    return firsts.union(rest.select("rank").join(followers, "rank", "left_anti"))


def resolve_entities(mentions: DataFrame, known: DataFrame, threshold: float = vectors.ENTITY, recall: float | None = None, log: list[int] | None = None) -> DataFrame:
    """(name_norm, lang, entity_id, made): resolve names of mentions to entities, or make them.

    `mentions` has name_norm, lang, entity_id (for a new entity), seq, embedding; `known` has entity_id,
    name_norm, lang, embedding. A name with a known key takes its entity. The others come once each,
    by `seq`: the nearest entity of any language at or above the threshold, the ones made before
    included (the earlier one of equals), or a new one. Null vectors, and those without a length or
    with other than finite numbers, are near nothing: such a name makes an entity. Empty names are
    left out.

    All pairs of vectors are compared exactly, by matrix products dealt over tasks (`tiles`). With
    `recall` (such as 0.9999) only pairs that share a hyperplane band are, which spares most of
    the products where the threshold is high and misses a pair at it with a probability of 1 - recall.
    """
    known_keys = known.select("name_norm", "lang", F.col("entity_id").alias("_known"))
    once = mentions.groupBy("name_norm", "lang").agg(F.min_by(F.struct("entity_id", "seq", "embedding"), F.struct("seq", "entity_id")).alias("f")).select("name_norm", "lang", "f.*").filter("name_norm <> ''")
    joined = neighbours.checkpointed(once.join(known_keys, ["name_norm", "lang"], "left"))
    exact = joined.filter("_known is not null").select("name_norm", "lang", F.col("_known").alias("entity_id"), F.lit(False).alias("made"))

    fresh = joined.filter("_known is null").select(F.lit(True).alias("new"), "seq", "name_norm", "lang", "entity_id", "embedding")
    old = known.select(F.lit(False).alias("new"), F.lit(None).cast(fresh.schema["seq"].dataType).alias("seq"), "name_norm", "lang", "entity_id", "embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Numbers that rise in this order, from the order of partitions after a sort.
    ordered = old.unionByName(fresh).orderBy("new", "seq", "entity_id", "name_norm", "lang")
    rows = neighbours.checkpointed(ordered.withColumn("rank", F.monotonically_increasing_id()).withColumn("vector", F.when(usable, F.col("embedding"))).drop("embedding", "seq"))

    compared = rows.filter("vector is not null").select("rank", "vector", "new")
    before = compared.filter("not new").select("rank", "vector")
    asking = compared.filter("new").select("rank", "vector")
    near_known = neighbours.checkpointed(_nearest(asking, before, threshold, recall))
    leads = neighbours.checkpointed(_leaders(neighbours.checkpointed(asking.join(near_known.select("rank"), "rank", "left_anti")), threshold, recall, log))
    # What is near a known entity takes one that was made only if that is as near.
    told = near_known.select("rank", F.col("similarity").alias("least"))
    following = asking.join(leads, "rank", "left_anti").join(told, "rank", "left").withColumn("least", F.coalesce("least", F.lit(float(threshold))))
    near_made = _nearest(following, asking.join(leads, "rank", "left_semi"), threshold, recall)
    nearest = near_known.union(near_made).groupBy("rank").agg(F.min_by("target", F.struct(-F.col("similarity"), "target")).alias("target"))
    taken = nearest.join(rows.select(F.col("rank").alias("target"), F.col("entity_id").alias("_taken")), "target").select("rank", "_taken")
    made = rows.filter("new").join(taken, "rank", "left")
    return exact.unionByName(made.select("name_norm", "lang", F.coalesce("_taken", "entity_id").alias("entity_id"), F.col("_taken").isNull().alias("made")))


def link_items(items: DataFrame, known: DataFrame, find: Callable[[Column], Column], embed: Callable[[Column], Column], threshold: float = vectors.ENTITY, own_names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(new entities, links) of items: their entities found, cleared of noise, resolved in the items' order, and linked.

    `items` has item_id, ts, title, summary, lang; `known` entity_id, name_norm, lang, embedding. `find` gives a
    model's raw list for a text ('' for a failure, which then links nothing), `embed` a vector or null for a
    name. New entities have entity_id, name, name_norm, lang, type, embedding; links entity_id, item_id,
    mention, lang, each once.
    """
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("en"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), T.clean_for_embedding(F.coalesce("summary", F.lit(""))))
    found = neighbours.checkpointed(items.select("item_id", "ts", lang.alias("lang"), find(text).alias("raw")))
    mentions = found.select("item_id", "ts", "lang", F.posexplode(verdict.entities(F.coalesce("raw", F.lit("")))).alias("at", "e"))
    mentions = mentions.select("item_id", "ts", "lang", "at", F.col("e.name").alias("mention"), F.col("e.type").alias("type"), names.normalize_name(F.col("e.name")).alias("name_norm"))
    mentions = neighbours.checkpointed(mentions.filter(~names.is_noise(F.col("mention"), own_names) & (F.col("name_norm") != "")))
    first = mentions.groupBy("name_norm", "lang").agg(F.min_by(F.struct(F.struct("ts", "item_id", "at").alias("seq"), F.col("mention").alias("name"), "type"), F.struct("ts", "item_id", "at")).alias("f"))
    key = F.left(F.sha2(F.concat("name_norm", F.lit("\0"), "lang"), 256), F.lit(16))
    once = neighbours.checkpointed(first.select("name_norm", "lang", "f.*", key.alias("entity_id"), embed(F.col("name_norm")).alias("embedding")))
    resolved = neighbours.checkpointed(resolve_entities(once, known, threshold))
    made = resolved.filter("made").select("name_norm", "lang").join(once, ["name_norm", "lang"]).select("entity_id", "name", "name_norm", "lang", "type", "embedding")
    links = mentions.join(resolved.select("name_norm", "lang", "entity_id"), ["name_norm", "lang"]).select("entity_id", "item_id", "mention", "lang").distinct()
    return made, links
