"""Folds against plain Python, boundary cases of windows and thresholds, order of input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import alerts, folds, vectors
from lantern.plans import catalogue, derive

SF = "/root/testdata/sf0.001"
SECOND = 1_000_000


def clusters(rows):
    found = {}
    for r in rows:
        found.setdefault((r.ccir, r.cluster), []).append(r.item_id)
    return sorted(map(sorted, found.values()))


def plain_centroids(items, threshold):
    out, sections = [], {}
    for item in items:
        sections.setdefault(item["ccir"], []).append(item)
    for section in sections.values():
        groups, centroids = [], []
        for item in sorted(section, key=lambda i: (-(i["score"] or 0), i["item_id"])):
            if item["embedding"] is None:
                groups.append([item])
                centroids.append(None)
                continue
            best, nearest = None, 1 - threshold
            for n, c in enumerate(centroids):
                if c is not None:
                    v = np.asarray(item["embedding"], float)
                    length = np.linalg.norm(c) * np.linalg.norm(v)
                    distance = 1.0 if length == 0 else 1 - float(v @ c) / length
                    if distance < nearest:
                        best, nearest = n, distance
            if best is None:
                groups.append([item])
                centroids.append(np.asarray(item["embedding"], float))
            else:
                groups[best].append(item)
                centroids[best] = sum(np.asarray(i["embedding"], float) for i in groups[best]) / len(groups[best])
        out += [sorted(i["item_id"] for i in g) for g in groups]
    return sorted(out)


def at_cosine(c):
    return [c, math.sqrt(1 - c * c)]


@pytest.mark.parametrize("items, threshold", [
    ([("a", "x", 9, [1.0, 0.0, 0.0, 0.0]), ("a", "y", 8, [1.0, 0.0, 0.0, 0.0]), ("a", "z", 7, [-1.0, 0.0, 0.0, 0.0]), ("a", "n", 6, None), ("a", "o", 5, [0.0] * 4)], 0.75),
    ([("a", "x", 9, [.1, .2, .3, .4]), ("a", "y", 8, [.11, .21, .31, .41]), ("a", "z", 7, [1.0, 0.0, 0.0, 0.0]), ("b", "w", 9, [.1, .2, .3, .4])], 0.75),
    ([("a", "x", 5, at_cosine(1.0)), ("a", "y", 5, at_cosine(0.76)), ("a", "z", 5, at_cosine(0.74)), ("a", "v", None, at_cosine(0.0))], 0.75),
])
def test_greedy_centroids(spark, items, threshold):
    frame = spark.createDataFrame(items, "ccir string, item_id string, score int, embedding array<float>")
    expected = plain_centroids([dict(zip(("ccir", "item_id", "score", "embedding"), i)) for i in items], threshold)
    assert clusters(folds.greedy_centroids(frame, threshold).collect()) == expected
    assert clusters(folds.greedy_centroids(frame.orderBy(F.desc("item_id")), threshold).collect()) == expected


def test_greedy_centroids_on_the_tables(spark):
    items = derive.enriched(spark, SF).filter("ccir <> 'none'").join(derive.item_embeddings(spark, SF).select("item_id", "embedding"), "item_id", "left")
    rows = [r.asDict() for r in items.select("ccir", "item_id", "score", "embedding").collect()]
    assert clusters(catalogue.cluster_greedy_centroid(spark, SF).collect()) == plain_centroids(rows, derive.TEST_SIMILARITY)


def test_greedy_keywords(spark):
    items = [("a", "1", 9, ["oil", "gas", "war"]), ("a", "2", 8, ["oil", "gas", "sea"]), ("a", "3", 7, ["sea", "war", "ice"]), ("a", "4", 6, ["sun", "oil"]), ("b", "5", 9, ["oil", "gas"]), ("a", "6", 5, None)]
    frame = spark.createDataFrame(items, "ccir string, item_id string, score int, words array<string>")
    assert clusters(folds.greedy_keywords(frame).collect()) == [["1", "2", "3"], ["4"], ["5"], ["6"]]


def test_claims_at_the_edge_of_their_time(spark):
    day = 86_400 * SECOND
    rows = [(1, "a", 0), (2, "a", day - 1), (3, "a", day), (4, "b", 5), (5, "a", 2 * day - 1), (6, "a", 2 * day)]
    frame = spark.createDataFrame(rows, "seq long, dedupe_id string, fired_at long")
    assert sorted(r.seq for r in folds.claim_alerts(frame).filter("fires").collect()) == [1, 3, 4, 6]


def plain_throttle(times):
    held, out = [], []
    for now in times:
        tier = next((n for n, s, m in (("60s", 60 * SECOND, 5), ("600s", 600 * SECOND, 10)) if sum(t > now - s for t in held) + 1 > m), None)
        held += [] if tier else [now]
        out.append(tier)
    return out


@pytest.mark.parametrize("times", [
    [i * SECOND for i in range(7)], [0, 1, 2, 3, 4, 60 * SECOND, 60 * SECOND + 1], [i * 50 * SECOND for i in range(14)], [59 * SECOND] * 3 + [61 * SECOND] * 4,
])
def test_throttle(spark, times):
    frame = spark.createDataFrame(list(enumerate(times)), "seq long, fired_at long")
    got = [r.tier for r in sorted(folds.throttle_alerts(frame).collect(), key=lambda r: r.seq)]
    assert got == plain_throttle(times)


def test_throttle_on_the_tables(spark):
    rows = sorted(catalogue.alert_throttle_fold(spark, SF).collect(), key=lambda r: (r.fired_at, r.seq))
    assert [r.tier for r in rows] == plain_throttle([r.fired_at for r in rows]) and rows


def test_sliding_counts_leave_out_the_far_end(spark):
    times = [0, 60 * SECOND, 60 * SECOND, 119 * SECOND, 600 * SECOND, 600 * SECOND + 1, 1199 * SECOND]
    frame = spark.createDataFrame(list(enumerate(times)), "seq long, fired_at long")
    for r in alerts.sliding_counts(frame).collect():
        for span in (60, 600):
            assert r[f"last_{span}s"] == sum(r.fired_at - span * SECOND < t <= r.fired_at for t in times)


def test_error_bursts(spark):
    rows = [("q", i, i == 4) for i in range(30)]
    frame = spark.createDataFrame(rows, "queue string, seq long, ok boolean")
    assert sorted(r.seq for r in folds.error_bursts(frame).collect()) == [14, 24]


def test_near_earlier_edges(spark):
    day = 86_400
    rows = [("a", 0, [1.0, 0.0]), ("b", 7 * day, at_cosine(0.95)), ("c", 14 * day + 1, at_cosine(0.95)), ("d", 14 * day + 1, at_cosine(0.95)), ("e", 30 * day, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "item_id string, s long, embedding array<float>").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r.item_id: r.duplicate_of for r in vectors.near_earlier(frame, 0.9).collect()}
    assert got == {"b": "a", "d": "c"}
