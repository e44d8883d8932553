"""Sharding: against a flat race in plain Python, growth, weights, slots, no Python on the main path."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lantern.llm import sharding


def race(key, tree):
    draws = [-math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / tree.weight(s) for s in range(tree.shards)]
    return draws.index(min(draws))


@pytest.mark.parametrize("tree", [sharding.Tree(), sharding.Tree(7, 3, 2), sharding.Tree(1, 1, 1), sharding.Tree(9, 2, 2, (1, 5, 0.5))])
def test_shards_and_growth(spark, tree):
    rows = sharding.shard_documents(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), tree).collect()
    for r in rows:
        assert r.shard == race(r.doc_id, tree) and r.grown_shard == race(r.doc_id, tree.grown())
        assert r.grown_shard in (r.shard, tree.shards)
        assert (r.rack, r.region) == (r.shard // tree.shards_per_rack, r.shard // tree.shards_per_rack // tree.racks_per_region)
    counts, total = Counter(r.shard for r in rows), sum(tree.weight(s) for s in range(tree.shards))
    for s in range(tree.shards):
        assert counts[s] == pytest.approx(3000 * tree.weight(s) / total, abs=6 * math.sqrt(3000 * tree.weight(s) / total) + 1)
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_movement_stays_in_the_subtree_that_grows(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r.doc_id: r for r in sharding.shard_documents(docs, sharding.Tree(8, 2, 2)).collect()}
    after = {r.doc_id: r for r in sharding.shard_documents(docs, sharding.Tree(8, 2, 2, (1, 1, 1, 4))).collect()}
    moved = [i for i in before if before[i].shard != after[i].shard]
    assert moved and all(after[i].shard == 3 for i in moved)


def test_odd_rows(spark):
    rows = [(1, "é"), (1, "é"), (1, "other"), (2, None), (None, ""), (3, "x" * 500_000)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, shard string")
    out = sharding.shard_documents(frame).collect()
    assert len(out) == 6 and len({(r.shard, r.slot) for r in out}) == 6
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(1, 18, zlib.crc32("é".encode())), (1, 21, zlib.crc32(b"other")), (2, 16, 0), (None, 16, 0), (3, 500_016, zlib.crc32(b"x" * 500_000))}
    assert sharding.shard_documents(frame.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_are_checked():
    with pytest.raises(ValueError):
        sharding.Tree(0)
    with pytest.raises(ValueError):
        sharding.Tree(3, weights=(1, 0, 1))
