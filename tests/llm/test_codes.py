"""Vector codes: the screening against all distances, whole fits against plain Python, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import codes


def all_distances(parts, entries):
    found = [min(((sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(entries))) for p in parts]
    return [i for _, i in found], [d for d, _ in found]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.sampled_from([1, 3, 1000, 1 << 20, 1 << 26]), st.integers(0, 10**6))
def test_nearest_against_all_distances(dims, count, most, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most + 1, (count, dims))
    parts = rng.integers(-most, most + 1, (30, dims))
    # Points half way between two entries, and next to it: ties and near ties that float32 can't tell apart.
    twins = entries[rng.integers(0, count, 30)] + entries[rng.integers(0, count, 30)]
    parts = np.concatenate((parts, twins // 2, entries))
    chosen, least = codes.nearest(parts, entries)
    assert (chosen.tolist(), least.tolist()) == all_distances(parts, entries)


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(1)
    for most in (5, 1 << 12, 1 << 25):
        parts, entries = rng.integers(-most, most + 1, (200, 16)), rng.integers(-most, most + 1, (64, 16))
        middle, radius = codes.intervals(parts, entries)
        for i in range(200):
            for j in range(64):
                exact = sum(int(e) ** 2 - 2 * int(p) * int(e) for p, e in zip(parts[i], entries[j]))
                # Fractions, for the comparison itself may not round.
                assert abs(exact - int(middle[i, j]) - (middle[i, j] - int(middle[i, j]))) <= radius[i, j]


def test_ties_that_only_integers_tell_apart():
    big = (1 << 26) - 1
    entries = np.array([[big, 0], [big, 1], [big - 1, 0], [big, 1]])
    chosen, least = codes.nearest(np.array([[big, 1], [big - 1, 1], [big, 0]]), entries)
    assert chosen.tolist() == [1, 1, 0] and least.tolist() == [0, 1, 0]


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract in Python integers. rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * 1024) for x in v] for _, v, _ in kept]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for w in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            chosen, _ = all_distances(cut[p], books[p])
            book = []
            for e, old in enumerate(books[p]):
                mine = [c for c, i in zip(cut[p], chosen) if i == e]
                book.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
            books[p] = book
    last = [all_distances(cut[p], books[p]) for p in range(parts)]
    out, by_label = [], {}
    for i, (vec_id, _, label) in enumerate(kept):
        out.append([vec_id, "".join(f"{last[p][0][i]:02x}" for p in range(parts)), sum(last[p][1][i] for p in range(parts)), label])
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(str, [(v, c, e, by_label[label]) for v, c, e, label in out])), digest


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def as_floats(v):
    return v and [x if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("n", [3, 40, 400])
def test_against_plain_rounds(spark, n):
    rng = random.Random(n)
    rows = [(i, as_floats([rng.gauss(0, 0.2) for _ in range(8)]), rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(n // 3)]  # copies
    rows += [(1, as_floats([0.25] * 8), 3), (1, as_floats([0.25] * 8), 3), (None, as_floats([-0.0] * 8), None)]
    rows += [(2, None, 1), (-5, [], 1), (-6, [None] * 8, 1), (-7, [math.nan] * 8, 1), (-8, [math.inf] + [0.0] * 7, 1), (-9, [0.0] * 7 + [-math.inf], None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = codes.compressed(frame).collect()
    expected, digest = plain(rows)
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got) == expected
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_fewer_entries_and_parts(spark):
    rng = random.Random(3)
    rows = [(i, as_floats([rng.gauss(0, 1) for _ in range(6)]), 0) for i in range(60)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = codes.compressed(frame, codes.Coding(parts=2, entries=7, rounds=2)).collect()
    assert (sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got), got[0].codebooks_sha256) == plain(rows, 2, 7, 2)


def test_many_labels(spark, monkeypatch):
    """With more labels than are broadcast, sums are joined."""
    monkeypatch.setattr(codes.shared, "small", lambda df, *_: df)
    rows = [(i, as_floats([i % 7, i % 3, 0.5, 0.1]), None if i % 5 == 0 else i % 11) for i in range(100)]
    got = codes.compressed(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), codes.Coding(entries=4)).collect()
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got) == plain(rows, entries=4)[0]


def test_empty_and_refused(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 6, 1, "x", 1)], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        codes.compressed(spark.createDataFrame([(1, [1e9] * 8, 1, "x", 1)], SCHEMA))
    with pytest.raises(Exception, match="different lengths"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 8, 1, "x", 1), (2, [1.0] * 4, 1, "x", 1)], SCHEMA)).count()
