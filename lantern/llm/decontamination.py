"""Benchmark decontamination by greedy string tiling.

Every window of `min_match` words of the benchmark is a seed, hashed as in Karp and Rabin's search.
A bitmap of the seeds, of bounded size, lets the pass over the documents emit only windows that may
be seeds; a join with the seeds keeps those that are. Seeds that follow one another in a document and in an item make up runs, found by a window over
each diagonal, so that what is brought together for a document and an item is runs and not pairs of
places. A greedy tiling marks the longest run that is still free, again and again, so that passages
count in whatever order they stand. An item whose words are covered to `percent` or more is leaked
by the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.llm import arrow, shared, text

#: Punctuation does not count, nor does case: all ASCII but letters and digits separates words.
_SEPARATE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Leak:
    min_match: int = 5  # words; items with fewer prove nothing and are never leaked
    percent: int = 80  # of an item's words


def words_of(value: str | None) -> np.ndarray:
    return text.word_hashes((value or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE))


def tiling(runs: Iterable[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words) from maximal runs of the same form."""
    waiting = [(-length, item, doc) for item, doc, length in runs]
    heapq.heapify(waiting)
    tiles, in_item, in_doc = [], set(), set()
    while waiting:
        length, item, doc = heapq.heappop(waiting)
        free = [item + k not in in_item and doc + k not in in_doc for k in range(-length)]
        if all(free):
            tiles.append((item, doc, -length))
            in_item.update(range(item, item - length))
            in_doc.update(range(doc, doc - length))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_match:
                    heapq.heappush(waiting, (start - k, item + start, doc + start))
                start = None
    return tiles


def seeds_of(benchmark: DataFrame, leak: Leak) -> DataFrame:
    """(item_id, n_item_words, seed, item_at): the windows of every item."""

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            words = words_of(row["text"])
            for at, seed in enumerate(text.window_hashes(words, leak.min_match).view(np.int64).tolist()):
                yield {"item_id": row["item_id"], "n_item_words": len(words), "seed": seed, "item_at": at}

    return arrow.map_rows(benchmark.select("item_id", "text"), run, arrow.schema(benchmark.schema["item_id"], "n_item_words int, seed long, item_at int"), rows=8192)


def _met(docs: DataFrame, bitmap: np.ndarray, leak: Leak) -> DataFrame:
    """(doc_id, text_key, seed, doc_at) of the documents' windows whose bit is set."""
    shared_bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        bits = shared_bits.value
        for row in rows:
            windows = text.window_hashes(words_of(row["text"]), leak.min_match)
            for at in np.flatnonzero(shared.may_hold(bits, windows)).tolist():
                yield {"doc_id": row["doc_id"], "text_key": row["text_key"], "seed": int(windows[at].view(np.int64)), "doc_at": at}

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return arrow.map_rows(rows, run, arrow.schema(docs.schema["doc_id"], "text_key long, seed long, doc_at int"), rows=4096)


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """The items that documents leak: a row for each such document (doc_id and text) and item.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are ignored. Returns
    doc_id, text_key (xxhash64 of the text), item_id, n_item_words, n_covered, coverage, n_tiles,
    longest_tile. Null and empty texts leak nothing and aren't leaked, nor are items shorter than
    `min_match` words. Repeated rows, of either table, are reported once. Empty tables give an empty
    result.
    """
    seeds = shared.staged(seeds_of(benchmark, leak), "leak-seeds")
    met = _met(docs, shared.bitmap(seeds, "seed"), leak)
    pair = ["doc_id", "text_key", "item_id", "n_item_words"]
    places = met.join(shared.small(seeds, 500_000), "seed")
    places = places.select(*pair, "item_at", (F.col("item_at") - F.col("doc_at")).alias("_diagonal")).distinct()
    # A diagonal has an item's length at most; places without a gap before them go on with a run.
    along = Window.partitionBy(*pair, "_diagonal").orderBy("item_at")
    places = places.withColumn("_run", F.col("item_at") - F.row_number().over(along))
    runs = places.groupBy(*pair, "_diagonal", "_run").agg(F.min("item_at").alias("item_at"), F.count(F.lit(1)).cast("int").alias("_seeds"))
    length = (F.col("_seeds") + leak.min_match - 1).alias("length")
    place = F.struct("item_at", (F.col("item_at") - F.col("_diagonal")).alias("doc_at"), length)
    together = runs.groupBy(*pair).agg(F.collect_list(place).alias("runs"), F.sum(length).alias("_reach"))
    # Runs alone bound what tiles can cover.
    together = together.filter(F.col("_reach") * 100 >= F.col("n_item_words") * leak.percent).drop("_reach")

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            tiles = tiling([(r["item_at"], r["doc_at"], r["length"]) for r in row.pop("runs")], leak.min_match)
            covered = sum(t[2] for t in tiles)
            if covered * 100 >= leak.percent * row["n_item_words"]:
                yield row | {"n_covered": covered, "coverage": covered / row["n_item_words"], "n_tiles": len(tiles), "longest_tile": max(t[2] for t in tiles)}

    ddl = "n_item_words int, n_covered int, coverage double, n_tiles int, longest_tile int"
    return arrow.map_rows(together, run, arrow.schema(docs.schema["doc_id"], "text_key long", benchmark.schema["item_id"], ddl))


def without_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) that leak no item, with all their columns.

    Null and empty texts stay. Repeated rows stay or go together. Further columns are carried along,
    whatever their names. An empty table stays empty, and an empty benchmark removes nothing.
    """
    leaks = find_leaks(docs, benchmark, leak).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    leaks = shared.small(shared.staged(leaks, "leaks"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_key"))
    return shared.packed(docs).join(leaks, same, "left_anti").select("_row.*")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
