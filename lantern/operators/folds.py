"""Order-dependent algorithms as streaming folds.

A fold sends each group's rows to one task, sorted by Spark, and the task reads them as a stream:
it holds the fold's state (centroids, key word sets, entities, time stamps), never the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lantern.operators import neighbours, ordering, tiles

Step = Callable[[dict], dict | None]


class _Rows:
    """A matrix that grows row by row."""

    def __init__(self) -> None:
        self.n, self.held = 0, np.zeros((0, 0))

    def add(self, row: np.ndarray) -> None:
        if self.n == len(self.held):
            grown = np.zeros((max(16, 2 * self.n), len(row)))
            if self.n:
                grown[: self.n] = self.held
            self.held = grown
        self.held[self.n] = row
        self.n += 1

    @property
    def matrix(self) -> np.ndarray:
        return self.held[: self.n]


def fold(df: DataFrame, group: list[str], order: list, start: Callable[[], Step], ddl: str) -> DataFrame:
    """Run a step made by `start` over each group's rows in order; a step returns a row or None.

    Without a group, everything is one fold and so one task.
    """
    schema = _parse_datatype_string(ddl)
    target = to_arrow_schema(schema)
    spread = df.repartition(*group).sortWithinPartitions(*group, *order) if group else df.repartition(1).sortWithinPartitions(*order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            names, columns = batch.schema.names, [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                yield dict(zip(names, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, now, held = None, None, []
        for row in rows(batches):
            key = tuple(row[g] for g in group)
            if step is None or key != now:
                step, now = start(), key
            made = step(row)
            if made is not None:
                held.append(made)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return spread.mapInArrow(run, schema)


def _placed(items: DataFrame, by: list[str], *columns) -> DataFrame:
    """Items with `rank`, their place by section, score and item_id among all, and `place`, that within the section."""
    # Staged before it is sorted, since a sort looks at its input twice.
    rows = neighbours.checkpointed(items.select(*by, "item_id", F.coalesce("score", F.lit(0)).alias("score"), *columns))
    ranked = neighbours.checkpointed(ordering.numbered(rows, [], [*by, F.col("score").desc(), "item_id"], "rank"))
    firsts = ranked.groupBy(*by).agg(F.min("rank").alias("_first")).select(*[F.col(c).alias(f"_{c}") for c in by], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return ranked.join(firsts, same).withColumn("place", (F.col("rank") - F.col("_first")).cast("int")).drop("_first", *[f"_{c}" for c in by])


def _folded(rows: DataFrame, links: DataFrame, by: list[str], start: Callable[[], Step]) -> DataFrame:
    """(by, cluster, place, item_id): folds of the parts of each section that `links` (u, v: ranks) hold together.

    A step gives item_id, place and the founder's rank; clusters are numbered by their founders.
    """
    found = ordering.components(links)
    parts = rows.join(found, F.col("rank") == F.col("node"), "left").withColumn("part", F.coalesce("root", "rank")).drop("node", "root")
    key = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    folded = neighbours.checkpointed(fold(parts, [*by, "part"], ["rank"], start, f"{key}, founder long, place int, item_id string"))
    numbers = ordering.numbered(folded.select(*by, "founder").distinct(), by, ["founder"], "cluster").select(F.col("founder").alias("_f"), F.col("cluster").cast("int").alias("cluster"))
    return folded.join(numbers, F.col("founder") == F.col("_f")).select(*by, "cluster", "place", "item_id")


def greedy_centroids(items: DataFrame, threshold: float = 0.75, by: Sequence[str] = ("ccir",)) -> DataFrame:
    """(ccir, cluster, place, item_id): greedy clustering by the nearest centroid, per requirement.

    `items` has ccir, item_id, score, embedding. Items come by score, then item_id; each joins the
    nearest centroid closer than 1 - threshold (the earlier one of equals), or founds a cluster. An
    item without a vector is a cluster of its own that no other can join. Instead of the requirement
    other columns may make up a section, such as the requirement and a window (`by`).

    A section is split into parts that can't meet, each of which is a fold of its own. An item only
    joins a cluster of which some member has a cosine of threshold squared to it: by induction the
    projections of the members on their centroid sum up to threshold times their lengths at
    least, so the centroid is at least so long, and the item's products with the members have a mean of
    threshold times that. So items that no chain of such cosines connects never share a cluster.
    """
    most, by = 1.0 - threshold, list(by)

    def start() -> Step:
        sums, means = _Rows(), _Rows()
        counts: list[int] = []
        founders: list[int] = []  # of the clusters that have a centroid

        def step(row: dict) -> dict:
            vector = None if row["embedding"] is None else np.asarray(row["embedding"], np.float64)
            joined = None
            if vector is not None and founders:
                lengths = np.linalg.norm(means.matrix, axis=1) * np.linalg.norm(vector)
                with np.errstate(divide="ignore", invalid="ignore"):
                    distance = np.where(lengths == 0, 1.0, 1.0 - means.matrix @ vector / lengths)
                best = int(np.argmin(distance))
                joined = best if distance[best] < most else None
            if joined is None:
                founder = row["rank"]
                if vector is not None:
                    sums.add(vector)
                    means.add(vector)
                    counts.append(1)
                    founders.append(founder)
            else:
                founder = founders[joined]
                sums.held[joined] += vector
                counts[joined] += 1
                means.held[joined] = sums.held[joined] / counts[joined]
            return {**{c: row[c] for c in by}, "founder": founder, "place": row["place"], "item_id": row["item_id"]}

        return step

    rows = neighbours.checkpointed(_placed(items, by, "embedding"))
    directed = rows.filter(F.exists("embedding", lambda x: x != 0)).select("rank", F.col("embedding").alias("vector"), *by)
    held = neighbours.checkpointed(tiles.tiles(directed, F.concat_ws("\0", *[F.col(c).cast("string") for c in by])))
    return _folded(rows, tiles.near_forest(held, threshold * threshold - tiles.EDGE), by, start)


PEELS = 2


def _word_links(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """(u, v): links between items (rank, words) of a section that share a word which can bring any together.

    An item that shares fewer than `least` of its words with any other is alone; without it, its words
    may be some other item's only, which then is alone as well. That is followed PEELS times; more
    would make parts smaller still, and never changes a cluster.
    """
    section = F.concat_ws("\0", *[F.col(c).cast("string") for c in by])
    words = rows.select("rank", section.alias("_section"), F.explode(F.array_distinct("words")).alias("_word"))
    held = neighbours.checkpointed(words.select("rank", F.xxhash64("_section", "_word").alias("word")))
    for _ in range(PEELS):
        common = held.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("word")
        able = held.join(common, "word", "left_semi")
        enough = able.groupBy("rank").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("rank")
        held = neighbours.checkpointed(able.join(enough, "rank", "left_semi"))
    first = held.groupBy("word").agg(F.min("rank").alias("v"))
    return held.join(first, "word").select(F.col("rank").alias("u"), "v")


def greedy_keywords(items: DataFrame, least: int = 2, by: Sequence[str] = ("ccir",)) -> DataFrame:
    """(ccir, cluster, place, item_id): greedy clustering by shared key words, per requirement.

    `items` has ccir, item_id, score, words (array). Each item joins the first cluster that shares
    `least` words with it, and the cluster's words grow. A section (`by`) is split into parts that share no
    word which could bring them together; each is a fold of its own.
    """
    by = list(by)

    def start() -> Step:
        clusters: list[set[str]] = []
        founders: list[int] = []
        places: dict[str, list[int]] = {}  # clusters by word, in order

        def step(row: dict) -> dict:
            words = set(row["words"] or ())
            shared: dict[int, int] = {}
            for word in words:
                for number in places.get(word, ()):
                    shared[number] = shared.get(number, 0) + 1
            number = min((n for n, c in shared.items() if c >= least), default=None)
            if number is None:
                number = len(clusters)
                clusters.append(set())
                founders.append(row["rank"])
            for word in words - clusters[number]:
                places.setdefault(word, []).append(number)
            clusters[number] |= words
            return {**{c: row[c] for c in by}, "founder": founders[number], "place": row["place"], "item_id": row["item_id"]}

        return step

    rows = neighbours.checkpointed(_placed(items, by, "words"))
    return _folded(rows, _word_links(rows, by, least), by, start)


def claim_alerts(attempts: DataFrame, ttl: int = 86_400_000_000) -> DataFrame:
    """Add `fires` to attempts (seq, dedupe_id, fired_at in microseconds): the first one, and the next ones `ttl` after a fire."""

    def start() -> Step:
        state: dict[str, int | None] = {"last": None}

        def step(row: dict) -> dict:
            fires = state["last"] is None or state["last"] <= row["fired_at"] - ttl
            if fires:
                state["last"] = row["fired_at"]
            return {"seq": row["seq"], "dedupe_id": row["dedupe_id"], "fired_at": row["fired_at"], "fires": fires}

        return step

    return fold(attempts.select("dedupe_id", "seq", "fired_at"), ["dedupe_id"], ["fired_at", "seq"], start, "seq long, dedupe_id string, fired_at long, fires boolean")


def _sessions(rows: DataFrame, gap: int) -> DataFrame:
    """Add `session`, a number that rises at each row (seq, fired_at) with no other one in the `gap` before it.

    Time is cut into pieces as long as the gap, and each piece is told the last row of the one before
    it. Only the totals of pieces go through one window, a row for each piece of time with alerts.
    """
    piece = F.expr(f"fired_at div {gap}")
    order = F.struct("fired_at", "seq")
    own = rows.withColumn("_piece", piece)
    last = own.groupBy((F.col("_piece") + 1).alias("_piece")).agg(F.max("fired_at").alias("_last"))
    inside = Window.partitionBy("_piece").orderBy(order)
    before = F.coalesce(F.lag("fired_at").over(inside), F.col("_last"))
    own = own.join(last, "_piece", "left").withColumn("_starts", F.coalesce(F.col("fired_at") - before >= gap, F.lit(True)).cast("long"))
    totals = own.groupBy("_piece").agg(F.sum("_starts").alias("_n"))
    totals = totals.select("_piece", (F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n")).alias("_before"))
    session = F.col("_before") + F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return own.join(totals, "_piece").withColumn("session", session).select("seq", "fired_at", "session")


def throttle_alerts(alerts: DataFrame, tiers: tuple[tuple[str, int, int], ...] = (("60s", 60_000_000, 5), ("600s", 600_000_000, 10))) -> DataFrame:
    """Add `tier` (null: delivered) to fired alerts (seq, fired_at): more than so many in a tier's time are suppressed.

    A window excludes what happened exactly its length ago and includes the alert itself; suppressed
    alerts no longer count. The cap is global and recursive, but after a gap of the longest window
    nothing counts any more: the alerts between two gaps are one session, and one fold. Its state is
    the alerts of the last window that were delivered.
    """
    longest = max(t[1] for t in tiers)

    def start() -> Step:
        held: list[int] = []

        def step(row: dict) -> dict:
            now = row["fired_at"]
            while held and held[0] <= now - longest:
                held.pop(0)
            tier = next((name for name, span, most in tiers if sum(t > now - span for t in held) + 1 > most), None)
            if tier is None:
                held.append(now)
            return {"seq": row["seq"], "fired_at": now, "tier": tier}

        return step

    return fold(_sessions(alerts.select("seq", "fired_at"), longest), ["session"], ["fired_at", "seq"], start, "seq long, fired_at long, tier string")


def error_bursts(results: DataFrame, most: int = 10) -> DataFrame:
    """(seq) at which `most` failures in a row were reached; the count begins anew there. `results` has queue, seq, ok."""

    def start() -> Step:
        state = {"n": 0}

        def step(row: dict) -> dict | None:
            state["n"] = 0 if row["ok"] else state["n"] + 1
            if state["n"] < most:
                return None
            state["n"] = 0
            return {"queue": row["queue"], "seq": row["seq"]}

        return step

    return fold(results.select("queue", "seq", "ok"), ["queue"], ["seq"], start, "queue string, seq long")
