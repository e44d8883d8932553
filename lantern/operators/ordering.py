"""Numbering rows in an order, and groups that hang together, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators import neighbours


def numbered(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """`df` with `out`, the place of each row (from 0) in its group by `order`, which should leave no ties.

    Rows are sorted by range partitions, so that a large group spreads over tasks. A row's place is its place in
    its partition and the number of rows of its group in the partitions before; only these counts,
    a row for each group of a partition, go through a window.
    """
    ordered = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = neighbours.checkpointed(ordered.withColumn("_part", F.shiftright("_at", 33)))
    counts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part")
    starts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in (*group, "_part")], "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, "_part")]
    return rows.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(out))


#: Links that one task follows, of 16 bytes each; more are followed in rounds.
FEW = 1_000_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links (u, v) of all batches."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(side) for side in zip(*held))
    nodes, places = np.unique(np.concatenate((u[u != v], v[u != v])), return_inverse=True)
    a, b = np.split(places, 2)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (u, v; longs) reaches, roots included.

    Up to FEW links are followed in one task. Of more, in each round a node looks at the least root around it,
    and roots are then replaced by theirs until nothing changes: the number of rounds is logarithmic in
    most graphs, and every round is staged.
    """
    edges = neighbours.checkpointed(edges.select("u", "v"))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_followed, "node long, root long")
    both = neighbours.checkpointed(edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = neighbours.checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("_least"))
        hooks = labels.join(around, "node").filter("_least < root").groupBy(F.col("root").alias("_top")).agg(F.min("_least").alias("_to"))
        hooks = neighbours.checkpointed(hooks)
        if hooks.isEmpty():
            return labels
        # Each root that met a lesser one goes there; then every label jumps to its root's label.
        moved = labels.join(hooks, F.col("root") == F.col("_top"), "left").select("node", F.coalesce("_to", "root").alias("root"))
        moved = neighbours.checkpointed(moved)
        tops = moved.select(F.col("node").alias("_top"), F.col("root").alias("_to"))
        labels = neighbours.checkpointed(moved.join(tops, F.col("root") == F.col("_top"), "left").select("node", F.coalesce("_to", "root").alias("root")))
