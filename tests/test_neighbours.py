"""Similar pairs by bands against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import neighbours, vectors

DAY = 86_400


def test_shape_keeps_its_recall():
    for threshold in (0.35, 0.75, 0.9, 0.92, 0.97, 1.0):
        bands, bits = neighbours.shape(threshold)
        agree = 1 - np.arccos(threshold) / np.pi
        assert bands <= neighbours.MOST_BANDS or bits == 1
        assert 1 - (1 - agree**bits) ** bands >= neighbours.RECALL - 1e-9
    for wrong in (0.0, -0.5, 1.5):
        with pytest.raises(ValueError):
            neighbours.shape(wrong)


def plain_near_earlier(rows, threshold, days=7):
    out = {}
    for name, at, v in rows:
        best = None
        for other, before, w in rows:
            inside = before >= at - days * DAY and ((before, other) < (at, name))
            if not inside or v is None or w is None or not (np.any(v) and np.any(w)):
                continue
            a, b = np.float32(v).astype(float), np.float32(w).astype(float)
            s = round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)
            if s >= threshold and (best is None or (-s, other) < best):
                best = (-s, other)
        if best:
            out[name] = best[1]
    return out


@pytest.mark.parametrize("threshold, piece", [(0.9, 2000), (0.9, 3), (0.6, 2000)])
def test_near_earlier_equals_brute_force(spark, monkeypatch, threshold, piece):
    """Clusters of close vectors, many copies of one, zero, missing and empty vectors, ties in time."""
    monkeypatch.setattr(neighbours, "PIECE", piece)
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((12, 24))
    rows = [(f"i{i:03}", int(draw.integers(0, 40)) * DAY, (centres[i % 12] + draw.normal(0, 0.2 + i % 3 / 10, 24)).tolist()) for i in range(150)]
    rows += [(f"c{i:03}", i // 3 * DAY, centres[0].tolist()) for i in range(40)]
    rows += [("n1", 0, None), ("z1", 0, [0.0] * 24), ("z2", DAY, [0.0] * 24), ("e1", 0, [])]
    frame = spark.createDataFrame(rows, "item_id string, s long, embedding array<float>").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r.item_id: r.duplicate_of for r in vectors.near_earlier(frame, threshold).collect()}
    expected = plain_near_earlier([(n, s, v if v else None) for n, s, v in rows], threshold)
    assert got == expected and len(got) > 40


def test_near_earlier_of_nothing(spark):
    frame = spark.createDataFrame([], "item_id string, created_at timestamp, embedding array<float>")
    assert vectors.near_earlier(frame).collect() == []


def test_many_targets_are_met_in_tiles(spark):
    """More targets than are broadcast give the same nearest one, zero and null vectors included."""
    rng = np.random.default_rng(8)
    vector = lambda i: None if i % 11 == 0 else [0.0] * 4 if i % 13 == 0 else np.round(rng.standard_normal(4), 1).tolist()
    items = spark.createDataFrame([(i, vector(i)) for i in range(120)], "item_id int, embedding array<float>")
    for some in ([(f"t{i}", vector(i)) for i in range(60)], [("t1", [-1.0, 0.0, 0.0, 0.0]), ("t2", [0.0] * 4)], [("z", [0.0] * 4)], []):
        targets = spark.createDataFrame([t for t in some if t[1] is not None], "t string, embedding array<float>")
        told = [[(r.item_id, r.t, r.similarity) for r in vectors.nearest(items, targets, "t", most).orderBy("item_id").collect()] for most in (1 << 20, -1)]
        assert told[0] == told[1] and len(told[0]) == 120
