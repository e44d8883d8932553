"""The index of cells: exact answers against a full scan, pruning, appended items, measured recall, odd rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import index, vectors

SCHEMA = "item_id string, embedding array<float>, bucket string, ccir string, ts timestamp"
TABLES = "/root/testdata/sf0.1"


def world(n, dims, seed, topics=30, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((topics, dims))
    rows = centres[rng.integers(0, topics, n)] + spread * rng.standard_normal((n, dims))
    return rows.astype(np.float32)


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    matrix = world(3000, 16, 1)
    rows = [(f"i{i:04d}", v.tolist(), ["read", "maybe", "skip"][i % 3], f"PIR-{i % 5}", None) for i, v in enumerate(matrix)]
    rows += [("none", None, "read", "PIR-1", None), ("zero", [0.0] * 16, "read", "PIR-1", None), ("odd", [math.nan] * 16, "read", "PIR-1", None), ("copy", matrix[5].tolist(), "read", "PIR-0", None)]
    items = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.hash("item_id") % 1000 + 10_000))
    index.build(items, path, cells=40)
    return items, path, matrix


def answers(df):
    return [(r.item_id, r.similarity) for r in df.orderBy(F.col("similarity").desc(), "item_id").collect()]


@pytest.mark.parametrize("asked", [0, 5, 77, 2999])
@pytest.mark.parametrize("filters", [{}, {"bucket": "maybe"}, {"ccir": "PIR-3", "since": dt.datetime(1970, 1, 1, 2, 50)}])
def test_equals_a_scan_of_all(spark, held, asked, filters):
    items, path, matrix = held
    log = {}
    usable = items.filter(~F.col("item_id").isin("none", "zero", "odd"))
    query = (matrix[asked] + 0.01).tolist()
    assert answers(index.recall(spark, path, query, 20, log=log, **filters)) == answers(vectors.recall(usable, query, 20, **filters))
    assert 0 < log["read"] < log["cells"] * (1 if filters else 0.5) + 1  # clustered vectors: most cells are ruled out


def test_files_of_other_cells_are_not_read(spark, held):
    _, path, _ = held
    plan = index.in_cells(spark, path, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and len(index.in_cells(spark, path, [1, 2]).inputFiles()) > 0
    assert {r.cell for r in index.in_cells(spark, path, [1, 2]).select("cell").distinct().collect()} == {1, 2}


def test_fewer_items_than_asked_for(spark, held):
    items, path, matrix = held
    few = items.filter("item_id < 'i0007'")
    got = answers(index.recall(spark, path, matrix[0].tolist(), 5000))
    assert len(got) == items.filter("bucket <> 'skip'").count() - 3 and few.count() == 8


def test_appended_items_are_found(spark, tmp_path):
    path, matrix = str(tmp_path / "i"), world(600, 8, 2)
    rows = [(f"i{i:03d}", v.tolist(), "read", "PIR-1", None) for i, v in enumerate(matrix)]
    first, later = spark.createDataFrame(rows[:400], SCHEMA), spark.createDataFrame(rows[400:] + [("far", [-9.0] * 8, "read", "PIR-1", None)], SCHEMA)
    index.build(first, path, cells=16)
    index.append(later, path)
    for query in (matrix[450].tolist(), [-1.0] * 8):
        assert answers(index.recall(spark, path, query, 10)) == answers(vectors.recall(first.union(later), query, 10))
    assert index.cells(spark, path).counts.sum() == 601


def measured(spark, path, asked, matrix, probes):
    """The share of the true ten nearest that are found."""
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    found = {}
    for r in index.recall_many(spark, path, asked, 10, probes).collect():
        found.setdefault(r.query_id, set()).add(r.item_id)
    queries = [r.query_id for r in asked.collect()]
    return np.mean([len(found[q] & {str(i) for i in np.argsort(-(unit @ unit[q]))[:10]}) / 10 for q in queries])


def test_many_queries_with_a_recall_of_nine_tenths(spark, tmp_path):
    """Every hundredth vector against all: of the test tables, which lie in all directions, and of vectors in topics."""
    table = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    matrix = np.array([r.embedding for r in table.orderBy("vec_id").collect()])
    index.build(table.select(F.col("vec_id").cast("string").alias("item_id"), "embedding"), str(tmp_path / "a"), cells=32)
    asked = table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    every, half = (measured(spark, str(tmp_path / "a"), asked, matrix, p) for p in (24, 16))
    topics = world(4000, 32, 5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(topics)], "query_id long, vector array<float>")
    index.build(rows.select(F.col("query_id").cast("string").alias("item_id"), F.col("vector").alias("embedding")), str(tmp_path / "b"), cells=64)
    near = measured(spark, str(tmp_path / "b"), rows.filter("query_id % 100 = 0"), topics, 8)
    print("recall", every, half, near)
    assert every >= 0.9 and near >= 0.95


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build(spark.createDataFrame([("a", None, "read", "x", None)], SCHEMA), path)
    assert index.recall(spark, path, [1.0, 0.0]).count() == 0
    assert index.recall_many(spark, path, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).count() == 0


def test_vectors_of_another_length_are_refused(spark, tmp_path):
    rows = [("a", [1.0, 0.0], "read", "x", None), ("b", [1.0], "read", "x", None)]
    with pytest.raises(Exception, match="components|inhomogeneous"):
        index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
