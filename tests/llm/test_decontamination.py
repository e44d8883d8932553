"""Leaks: tiling against brute-force greedy string tiling, reordered passages, odd rows."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import decontamination as dec
from lantern.llm import text


def brute_tiling(item, doc, least):
    """Longest common free stretch, marked, until none of `least` words is left."""
    used_item, used_doc, lengths = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in used_item and j + k not in used_doc:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return lengths
        lengths.append(best[0])
        used_item |= set(range(best[1], best[1] + best[0]))
        used_doc |= set(range(best[2], best[2] + best[0]))


def runs(item, doc, least):
    """All common stretches of `least` words or more that can't be made longer."""
    out = []
    for i in range(len(item)):
        for j in range(len(doc)):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            k = 0
            while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k]:
                k += 1
            if k >= least:
                out.append((i, j, k))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 2), max_size=14))
def test_tiling_equals_brute_force(item, doc):
    tiles = dec.tiling(runs(item, doc, 3), 3)
    assert [t[2] for t in tiles] == brute_tiling(item, doc, 3)


def test_window_hashes_stand_for_windows():
    rng = random.Random(1)
    words = [rng.choice("ab") for _ in range(300)]
    hashes = text.window_hashes(text.word_hashes(" ".join(words).encode()), 5)
    windows = [tuple(words[i : i + 5]) for i in range(296)]
    assert len(set(hashes.tolist())) == len(set(windows))
    assert all((hashes[i] == hashes[j]) == (windows[i] == windows[j]) for i in range(50) for j in range(296))


def test_word_hashes_in_segments(monkeypatch):
    data = ("word " * 50 + "é" * 40 + "\n x").encode()
    whole = text.word_hashes(data)
    monkeypatch.setattr(text, "_SEGMENT", 7)
    assert np.array_equal(text.word_hashes(data), whole) and len(whole) == 52


def test_leaks(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + item + noise(50))),
        (2, " ".join(noise(5) + item[20:] + noise(30) + item[:20])),  # reordered
        (3, ", ".join(w.upper() for w in item)),  # other case and punctuation
        (4, " ".join(noise(80) + item[:20])),  # half of it
        (5, None), (6, ""), (7, " ".join(noise(3000))),
        (1, " ".join(noise(50))),  # the same id with another text
        (None, " ".join(item)),
    ]
    docs += [docs[0]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, " ".join(item), 1), (8, "too short", 1), (7, None, 1)], "item_id long, text string, doc_id int")
    found = dec.find_leaks(frame, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_covered) for r in found) == [("1", 9, 40), ("2", 9, 40), ("3", 9, 40), ("None", 9, 40)]
    assert {r.doc_id: r.n_tiles for r in found}[2] == 2
    clean = dec.without_leaks(frame, items)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 4, 5, 6, 7]
    assert dec.find_leaks(frame.limit(0), items).count() == 0
    assert dec.find_leaks(frame, items.limit(0)).count() == 0


def test_a_long_text_of_one_word(spark):
    """A repeated word meets a repetitive item in runs along diagonals, not in pairs of places."""
    frame = spark.createDataFrame([(1, "ha " * 20_000), (2, "ha " * 60 + "ho")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "ha " * 50), (8, "ha " * 20 + "hi ho hum he " * 5)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in dec.find_leaks(frame, items).collect()) == [(1, 9, 50, 1), (2, 9, 50, 1)]


def test_query_equals_brute_force_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): r.n_covered for r in dec.op8_leaks(spark, sf).collect()}
    items = [(r.item_id, dec.words_of(r.text).tolist()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        doc = dec.words_of(row.text).tolist()
        at = {}
        for j in range(len(doc) - 4):
            at.setdefault(tuple(doc[j : j + 5]), []).append(j)
        for item_id, item in items:
            seeds = [j for i in range(len(item) - 4) for j in at.get(tuple(item[i : i + 5]), [])]
            if seeds:
                near = doc[max(0, min(seeds) - 60) : max(seeds) + 60]
                covered = sum(brute_tiling(item, near, 5))
                if covered * 100 >= 80 * len(item):
                    expected[row.doc_id, item_id] = covered
    assert got == expected and got
