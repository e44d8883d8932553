"""SimHash near-duplicates: exact comparison of fingerprints in tiles, skipping tiles by bit counts.

1. Every text becomes a fingerprint of 64 bits: each bit is what most of its shingles' hashes have
   there. Documents with one fingerprint form a class; later work is on the distinct fingerprints.
2. Two fingerprints differ in at least as many bits as their numbers of set bits do; and the same
   holds in sum for any division of the bits into groups. Fingerprints are laid into tiles by their
   bit counts, in one group or more: the more fingerprints, the more groups, so that the tiles
   stay of a like size. A tile is further cut at random where it would hold more than a task's work.
3. Tile pairs whose bit counts differ beyond the radius are skipped, and never formed: a key's
   neighbours within the radius are listed, and only those that exist are joined.
4. Each other pair of tiles is compared in full by exclusive-or and bit counts of whole matrices.
   Of its links a spanning forest is kept, so that a crowd of like fingerprints gives as many links as
   it has members and not their square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, graph, shared

BITS = 64
SEED = 42
#: Fingerprints in a tile, about; a typical tile has fewer.
TILE = 4096
#: Fingerprints that a tile has on average before bit counts are taken in more groups.
CROWDED = 1024
#: Numbers of groups, and how many different bit counts random fingerprints have with so many.
GROUPS = ((1, 16), (2, 136), (4, 4_600), (8, 1_300_000))
_HASHES, _ROWS = 1 << 15, 256


@dataclass(frozen=True)
class Closeness:
    """Shingles of `words` words; fingerprints are linked from `radius` differing bits down."""

    words: int = 3
    radius: int = 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text, letters A to Z in lower case; 0 for one without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    begins = starts[: len(found) - width + 1].tolist()
    ends = (starts + lengths)[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, len(begins), _HASHES):
        places = zip(begins[low : low + _HASHES], ends[low : low + _HASHES])
        hashes = np.array([digest(line[a:b], SEED) for a, b in places], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint, as a signed long, of every row of `docs` (doc_id, text)."""

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            value = fingerprint(row["text"], words)
            yield {"doc_id": row["doc_id"], "bits": value - (1 << BITS) if value >> 63 else value}

    return arrow.map_rows(docs.select("doc_id", "text"), run, arrow.schema(docs.schema["doc_id"], "bits long"), rows=8192)


def group_count(n: int) -> int:
    """In how many groups bits are counted for `n` fingerprints."""
    return next((g for g, kinds in GROUPS if n <= kinds * CROWDED), GROUPS[-1][0])


def _count_key(groups: int) -> Column:
    """The bit counts of the groups as one long, 7 bits each."""
    width = BITS // groups
    mask = -1 if groups == 1 else (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("bits", g * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long") for g in range(groups)]
    key = counts[0]
    for g, count in enumerate(counts[1:], 1):
        key = key.bitwiseOR(F.shiftleft(count, 7 * g))
    return key


def offsets(groups: int, radius: int) -> list[list[int]]:
    """All steps between the bit counts of fingerprints at `radius` or less; of a step and its opposite only one."""
    found: list[list[int]] = []
    for spread in itertools.product(range(-radius, radius + 1), repeat=min(groups, radius)):
        for places in itertools.combinations(range(groups), len(spread)):
            step = [0] * groups
            for place, by in zip(places, spread):
                step[place] = by
            if sum(map(abs, step)) <= radius and step >= [-x for x in step]:
                found.append(step)
    return [list(s) for s in sorted(set(map(tuple, found)))]


def _neighbours(keys: DataFrame, groups: int, radius: int) -> DataFrame:
    """(key, other): each of `keys` (key, n_tiles) with those of them at most `radius` away, itself included, each pair once."""
    # A step shifts every count at once, and none below 0 or above what 7 bits hold: such keys don't exist, but could look like others that do.
    width = BITS // groups
    counts = [F.shiftright("key", 7 * g).bitwiseAND(F.lit(127).cast("long")) for g in range(groups)]
    targets = []
    for step in offsets(groups, radius):
        fits = F.lit(True)
        for count, by in zip(counts, step):
            if by:
                fits = fits & (count + by >= 0) & (count + by <= width)
        targets.append(F.when(fits, F.col("key") + F.lit(sum(by * (1 << 7 * g) for g, by in enumerate(step))).cast("long")))
    listed = keys.select("key", "n_tiles", F.explode(F.array_compact(F.array(*targets))).alias("other"))
    return listed.join(keys.select(F.col("key").alias("other"), F.col("n_tiles").alias("n_others")), "other")


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that links `u`-`v` reach from each of the nodes 0 to n - 1."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
    return root


def linked(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as fingerprints) of a spanning forest over all pairs of `x` and `y` that differ in at most `radius` bits."""
    both = np.concatenate((x, y))
    root = np.arange(len(both))
    for start in range(0, len(x), _ROWS):
        near = np.bitwise_count(x[start : start + _ROWS, None] ^ y[None, :]) <= radius
        row, column = np.nonzero(near)
        if len(row):
            root = forest(np.concatenate((root, row + start)), np.concatenate((np.arange(len(both)), column + len(x))), len(both))
    moved = np.flatnonzero((root != np.arange(len(both))) & (both[root] != both))
    if np.array_equal(x, y):  # a tile with itself has each fingerprint twice
        moved = moved[moved < len(x)]
    return both[moved], both[root[moved]]


def _tiles(classes: DataFrame, groups: int) -> DataFrame:
    """(key, tile, held): the fingerprints of each tile as bytes; `classes` has bits (distinct, staged)."""
    keyed = classes.select("bits", _count_key(groups).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    cuts = sizes.select("key", F.ceil(F.col("_n") / TILE).cast("int").alias("n_tiles"))
    # Only keys with more than one tile need to be told; there are at most one for every TILE fingerprints.
    many = shared.staged(cuts.filter("n_tiles > 1"), "simhash-cuts")
    dealt = keyed.join(shared.small(many), "key", "left")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("bits"), F.coalesce("n_tiles", F.lit(1))).cast("int"))
    return dealt.groupBy("key", "tile").agg(F.collect_list("bits").alias("held"), F.coalesce(F.first("n_tiles"), F.lit(1)).alias("n_tiles"))


def links(classes: DataFrame, radius: int, groups: int | None = None) -> DataFrame:
    """(u, v): links that join whatever of `classes` (bits: distinct longs, staged) differs in at most `radius` bits."""
    groups = group_count(classes.count()) if groups is None else groups
    tiles = shared.staged(_tiles(classes, groups), "simhash-tiles")
    keys = shared.staged(tiles.groupBy("key").agg(F.max("n_tiles").alias("n_tiles")), "simhash-keys")
    near = _neighbours(keys, groups, radius)
    pairs = near.select("key", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("tile"), "other", "n_others")
    pairs = pairs.select("key", "tile", "other", F.explode(F.sequence(F.lit(0), F.col("n_others") - 1)).alias("other_tile"))
    pairs = shared.staged(pairs.filter("key <> other OR tile <= other_tile"), "simhash-pairs")
    left = tiles.select("key", "tile", F.col("held").alias("x"))
    right = tiles.select(F.col("key").alias("other"), F.col("tile").alias("other_tile"), F.col("held").alias("y"))
    met = pairs.join(left, ["key", "tile"]).join(right, ["other", "other_tile"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            xs, ys = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                x, y = (np.asarray(side[i].values.to_numpy(zero_copy_only=False)).view(np.uint64) for side in (xs, ys))
                u, v = linked(x, y, radius)
                if len(u):
                    yield {"u": u.view(np.int64), "v": v.view(np.int64)}

    return arrow.map_batches(met, run, "u long, v long")


def near_duplicates(docs: DataFrame, closeness: Closeness = Closeness()) -> DataFrame:
    """doc_id, fingerprint, component_id (the least doc_id that links reach) of every row of `docs` (doc_id, text; other columns are ignored).

    A null or empty text, and one without words, has fingerprint 0 and is linked like any other.
    Documents with null doc_id are linked as well, but don't name a component unless it has no other;
    repeated rows share a component. An empty table gives an empty result.
    """
    rows = shared.staged(fingerprints(docs, closeness.words), "simhash-rows")
    classes = shared.staged(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = graph.components(shared.staged(links(classes.select("bits"), closeness.radius), "simhash-links"))
    rooted = classes.join(found.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = shared.staged(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shared.staged(shared.join_hot(rooted, least, "root").select("bits", "component_id"), "simhash-named")
    out = shared.join_hot(rows, named, "bits")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
