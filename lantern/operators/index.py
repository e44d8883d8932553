"""A persisted index of vectors for recall: an inverted file of cells, with an exact answer from few of them.

Vectors are laid into cells by the nearest of a number of centres and written as Parquet, partitioned
by cell. A small table beside them holds each cell's centre, number of vectors and the widest
angle between the centre and a vector. By the triangle inequality of angles no vector of a cell is nearer
to a query than the angle to the centre less that width. A query reads the nearest cells first; the k-th
similarity found there shows which of the others may still hold a nearer vector, and only those are
read as well. So the answer is exact, and cells are skipped by partition pruning. Where a
recall below 1 will do, `probes` limits how many cells are read at all.

Centres are fitted to a sample of bounded size (`SAMPLE`); every vector is laid into a cell, whatever
the sample. Items that come later are appended under the centres that are there, and widths grow.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lantern.operators import vectors

#: Vectors that centres are fitted to, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Slack on angles, for the rounding of their computation.
SLACK = 1e-6
_SEED = 7


@dataclass(frozen=True)
class Cells:
    """Centres (unit vectors), numbers of vectors and widths (radians) of an index."""

    centres: np.ndarray
    counts: np.ndarray
    widths: np.ndarray

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The least angle that a vector of each cell can have to the query."""
        angles = np.arccos(np.clip(self.centres @ (query / np.linalg.norm(query)), -1, 1))
        return np.maximum(0, angles - self.widths - SLACK)


def fit_centres(items: DataFrame, cells: int) -> np.ndarray:
    """At most `cells` unit vectors, by rounds of spherical k-means over a sample of SAMPLE vectors, chosen by a hash of item_id."""
    usable = items.filter(_usable(F.col("embedding")))
    sample = usable.select("embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    matrix = np.array([r.embedding for r in sample], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    matrix = np.unique(matrix, axis=0)
    centres = matrix[np.random.default_rng(_SEED).permutation(len(matrix))[:cells]]
    for _ in range(ROUNDS):
        cell = np.argmax(matrix @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, matrix)
        lengths = np.linalg.norm(sums, axis=1)
        centres = np.where(lengths[:, None] > 0, sums / np.where(lengths, lengths, 1)[:, None], centres)
    return centres


def _usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def placed(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """`items` with `cell` and `angle` (to its centre); rows without a usable vector are left out, since no query finds them."""
    rows = items.filter(_usable(F.col("embedding")))
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    target = to_arrow_schema(schema)
    place = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                column = part.column(place)
                lengths = np.diff(column.offsets.to_numpy())
                if (lengths != centres.shape[1]).any():
                    raise ValueError(f"the index holds vectors of {centres.shape[1]} components, not of {int(lengths[lengths != centres.shape[1]][0])}")
                matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
                near = matrix @ centres.T / np.linalg.norm(matrix, axis=1)[:, None]
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], schema=target)

    return rows.mapInArrow(run, schema)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # The rows of a cell go to a few files: a cell is dealt to more tasks the more rows it may hold.
    rows.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(4))).write.mode(mode).partitionBy("cell").parquet(f"{path}/items")


def _items(spark: SparkSession, path: str) -> DataFrame:
    """The items of an index, under the schema that is kept beside them (an index may have no files)."""
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first().json))
    return spark.read.schema(schema).parquet(f"{path}/items")


def _facts(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n, width) from what is written; angles alone are read."""
    return _items(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width"))


def build(items: DataFrame, path: str, cells: int = 64) -> None:
    """Write an index of `items` (item_id, embedding and any columns to filter by or return) to the folder `path`.

    Rows with a null vector, one without a length or with other than finite numbers are not in it.
    Vectors of different lengths are refused. An index of nothing has no cells and answers nothing.
    """
    centres = fit_centres(items, cells)
    spark = items.sparkSession
    rows = placed(items, centres) if len(centres) else items.limit(0).withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0))
    _write(rows, path, "overwrite")
    spark.createDataFrame([(rows.schema.json(),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    held = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write_cells(spark, path, 0)


def _write_cells(spark: SparkSession, path: str, version: int) -> None:
    """The cells' facts go to a folder of their own, which readers take once it is complete; there is a row a cell."""
    facts = spark.read.parquet(f"{path}/centres").join(_facts(spark, path), "cell", "left").select("cell", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("width", F.lit(0.0)).alias("width"), F.lit(version).alias("version"))
    facts.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/cells")


def cells(spark: SparkSession, path: str) -> Cells:
    """The cells of an index, as of its last version."""
    facts = spark.read.parquet(f"{path}/cells") if _has_cells(spark, path) else None
    rows = [] if facts is None else facts.filter(F.col("version") == facts.agg(F.max("version")).first()[0]).orderBy("cell").collect()
    if not rows:
        return Cells(np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    return Cells(np.array([r.centre for r in rows]), np.array([r.n for r in rows]), np.array([r.width for r in rows]))


def _has_cells(spark: SparkSession, path: str) -> bool:
    return not spark.read.parquet(f"{path}/centres").isEmpty()


def append(items: DataFrame, path: str) -> None:
    """Add `items` to an index, under the centres that are there."""
    spark = items.sparkSession
    facts = spark.read.parquet(f"{path}/cells")
    version = facts.agg(F.max("version")).first()[0]
    _write(placed(items, cells(spark, path).centres), path, "append")
    _write_cells(spark, path, version + 1)


def in_cells(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The items of some cells; the others' files are never opened."""
    return _items(spark, path).filter(F.col("cell").isin(*numbers) if numbers else F.lit(False))


def recall(
    spark: SparkSession, path: str, query: list[float], k: int = 50, bucket: str | None = None, ccir: str | None = None, since=None, first: int = 4, probes: int | None = None, log: dict | None = None
) -> DataFrame:
    """`vectors.recall` over an index: the `k` nearest items after the filters, with `similarity`.

    The `first` cells nearest to the query (more where the filters leave too few) are read to find the k-th similarity, then every other
    cell whose bound does not rule out a nearer (or, at equal similarity, an earlier) item. With `probes` no
    more than so many cells are read, which may miss some. `log` gets the number of cells and of those read.
    """
    held = cells(spark, path)
    asked = np.asarray(query, np.float64)
    rows = lambda numbers: vectors.recall(in_cells(spark, path, numbers), query, k, bucket, ccir, since)
    filled = np.flatnonzero(held.counts > 0)
    if not len(filled) or not np.isfinite(asked).all() or not asked.any():
        return rows(filled.tolist())
    order = filled[np.argsort(held.bounds(asked)[filled], kind="stable")]
    most = len(order) if probes is None else min(probes, len(order))
    near = order[: min(first, most)].tolist()
    best = rows(near).select("similarity").collect()  # k rows
    while len(best) < k and len(near) < most:  # the filters left too few
        near = order[: min(2 * len(near), most)].tolist()
        best = rows(near).select("similarity").collect()
    floor = min(r.similarity for r in best) if len(best) == k else -1.0
    # Similarities are rounded to 6 places, so what is within half of the last one may still come in.
    reach = math.acos(max(-1.0, min(1.0, floor - 1e-6)))
    more = [int(c) for c in order[len(near) : most] if held.bounds(asked)[c] <= reach]
    if log is not None:
        log.update(cells=len(filled), read=len(near) + len(more))
    return rows(near + more)


def recall_many(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, item_id, similarity): the k nearest of `probes` cells for each of `queries` (query_id, vector); approximate.

    Queries and items meet by cell, so that a query's work is what its cells hold. Not a driver loop: any number of queries.
    """
    held = cells(spark, path)
    filled = np.flatnonzero(held.counts > 0)
    if not len(filled):
        return queries.limit(0).select("query_id", F.lit(None).cast(_items(spark, path).schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"))
    centres = held.centres[filled]

    @F.pandas_udf("array<int>")
    def nearest(found: pd.Series) -> pd.Series:
        matrix = np.stack([np.asarray(v, np.float64) for v in found])
        order = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(filled[order].astype(np.int32)))

    asked = queries.filter(_usable(F.col("vector"))).select("query_id", "vector", F.explode(nearest("vector")).alias("cell"))
    items = _items(spark, path).select("item_id", "embedding", "cell")
    scored = asked.join(items, "cell").select("query_id", "item_id", F.round(vectors.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))
    by_rank = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id")
    return scored.withColumn("_rank", F.row_number().over(by_rank)).filter(F.col("_rank") <= k).drop("_rank")  # limited before it is shuffled
