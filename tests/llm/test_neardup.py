"""Near-duplicates: against all pairs, hot groups, odd rows; sketches and components on their own."""

import random

import numpy as np
import pytest

from lantern.llm import graph, neardup, text


def components(rows, likeness):
    """All pairs of documents, compared on their shingles."""
    sets = []
    for _, value in rows:
        words = (value or "").encode().lower().split()
        n = likeness.words
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= likeness.percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows = []
    for base in range(4):
        words = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    return rows + [(2000 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]


@pytest.mark.parametrize("likeness", [neardup.Likeness(3, 85), neardup.Likeness(5, 80)])
def test_components_against_all_pairs(spark, likeness):
    rows = corpus(likeness.words) + [(3000, None), (3001, ""), (3002, " \n"), (3003, "One"), (3004, "one "), (3005, "one two"), (None, "a null id"), (3006, "a NULL id"), (3007, "x\ty z"), (3007, "x\ty z")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    got = neardup.near_duplicates(frame, likeness).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, likeness)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, "", "s"), (4, None, "s"), (5, "other words here", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    rows = [
        (1, "a b c d e f"), (None, "A b c d e f"),  # a copy without an id
        (None, "clean words that stand alone here"), (None, ""), (None, ""),
        (7, "a b c d e F"), (7, "seven has another text as well"),  # one of two texts is a copy
        (8, "eight q r s t u v w x y z"), (8, "eight q r s t u v w x y z k"),  # near copies that share an id
        (None, "null q r s t u v w x y z"), (None, "null q r s t u v w x y z k"),  # or have none
        (9, None), (9, None),
    ]
    kept = sorted((str(r.doc_id), r.text) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text)
    ids = [(d, t.split()[0]) for d, t in kept]
    assert ids == [("1", "a"), ("7", "seven"), ("8", "eight"), ("None", "clean"), ("None", "null")]
    without = [r for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.text]
    assert len(without) == 4


def test_many_ids_and_hot_groups_take_another_way_to_the_same_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(40)) for _ in range(4)]
    rows = [(i, base[0 if i % 2 else i % 4] + f" tail{i % 9}") for i in range(120)] + [(None, base[1]), (500, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "IN_MEMORY", 0)
    monkeypatch.setattr(neardup.shared, "HOT_ROWS", 0)
    got = neardup.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, neardup.Likeness())


def test_empty_and_long(spark):
    frame = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100_000))), (2, " ".join(f"w{i}" for i in range(100_001)))], "doc_id long, text string")
    assert [r.component_id for r in neardup.near_duplicates(frame).collect()] == [1, 1]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 60, 700, 9000])
def test_registers_agree_as_often_as_sets(n):
    rng = np.random.default_rng(n)
    agree = []
    for _ in range(40):
        shared, one, other = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for k in (17 * n, 2 * n, n))
        a, b = np.unique(np.concatenate((shared, one))), np.unique(np.concatenate((shared, other)))
        agree.append((neardup.registers(a) == neardup.registers(b)).mean())
    assert np.mean(agree) == pytest.approx(17 / 20, abs=0.05)


def test_components_of_a_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(300):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    assert got == {n: r for n, r in least.items() if n != r}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes_are_of_the_words():
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    hashes = text.word_hashes(" \t".join(words).encode())
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
