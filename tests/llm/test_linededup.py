"""Line dedup: against all pairs of lines, hot groups in blocks, crowds, odd rows."""

import random

import numpy as np
import pytest

from lantern.llm import graph
from lantern.llm import linededup as dedup


def expected(rows, percent):
    """All pairs of classes, compared in full."""
    lines = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for number, line in enumerate((text or "").split("\n")):
            words = frozenset(line.encode().lower().split())
            if words:
                lines.append((doc_id, number, words))
    first = {}
    for doc_id, number, words in lines:
        first.setdefault(words, (doc_id, number))
    place = {words: n for n, words in enumerate(first)}
    near = {w: [v for v in first if v != w and len(w & v) * 100 >= percent * len(w | v)] for w in first}
    out, seen = [], set()
    for doc_id, number, words in lines:
        removed = words in seen or any(place[v] < place[words] for v in near[words])
        seen.add(words)
        out.append((doc_id, number, *first[words], len(near[words]), removed))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "é"]
    base = [rng.choices(vocabulary, k=rng.randint(1, 25)) for _ in range(12)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "\t"]).join(line))
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("similar", [dedup.Similar(), dedup.Similar(block=3), dedup.Similar(crowd=4), dedup.Similar(percent=60, block=5)])
def test_lines_against_all_pairs(spark, similar):
    rows = corpus(similar.block) + [(100, None), (101, ""), (102, " \n\t\n"), (None, "only here x y z"), (103, "A b c d e\nA b c d e f")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line_no string")
    got = sorted((tuple(r) for r in dedup.line_links(frame, similar).collect()), key=str)
    assert got == expected(rows, similar.percent)


def test_repeated_rows_long_texts_and_empty_tables(spark):
    text = "alpha beta gamma\n" + " ".join(f"t{i}" for i in range(60_000))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = dedup.line_links(frame).collect()
    assert len(rows) == 6 and sorted(r.removed for r in rows) == [False] * 2 + [True] * 4
    assert dedup.line_links(frame.limit(0)).count() == 0


def test_texts_lose_their_repeats(spark):
    frame = spark.createDataFrame([(1, "a b c d e\n\nx"), (2, "a b c d e f\ny\nX"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in dedup.without_repeats(frame).collect()}
    assert out == {1: "a b c d e\n\nx", 2: "y", 3: None}


def test_lines_of_texts():
    lines = dedup.lines_of(["a b\n\n b a A", None, "", "c"])
    assert lines.doc.tolist() == [0, 0, 3] and lines.number.tolist() == [0, 2, 0] and lines.size.tolist() == [2, 2, 1]
    keys = lines.keys()
    assert keys[0] == keys[1] != keys[2]
    assert len(dedup.lines_of([]).size) == 0 and np.array_equal(dedup.prefix_length(np.array([1, 4, 5, 10]), 80), [1, 1, 2, 3])


@pytest.mark.parametrize("rows", [10, 4, 3])
def test_a_crowd_is_linked_to_its_last_posting(spark, rows):
    """One word over several batches, the last of which holds the next word too; tail rows resemble only rows of the first batch."""
    name, size = "spark.sql.execution.arrow.maxRecordsPerBatch", dedup.SIZE_BITS
    odd = lambda i: 0 if i in (2, 3, 10, 11) else -1
    postings = [((1 << size) | 100 + i, i, (100 + i) << 32, odd(i), odd(i)) for i in range(12)]
    postings += [((2 << size) | 100, 100 + i, 100 << 32, 0, 0) for i in range(2)] + [((3 << size) | 100, 200, 100 << 32, 0, 0)]
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        frame = spark.createDataFrame(postings, "word long, key long, shape long, odd0 long, odd1 long").coalesce(1)
        found = graph.components(dedup._candidates(frame, dedup.Similar(crowd=2))).collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 12)} | {(101, 100)}


def test_more_lines_than_the_sort_has_bits_for():
    first, last = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    lines = dedup.lines_of([" ".join(first) + "\n" * (1 << 20) + " ".join(last)])
    assert lines.number.tolist() == [0, 1 << 20] and lines.size.tolist() == [30, 30] and lines.doc.tolist() == [0, 0]
    apart = [dedup.lines_of([" ".join(words)]) for words in (first, last)]  # also texts without a line feed
    assert lines.keys().tolist() == [x.keys()[0] for x in apart]
    line = np.repeat([0, 1 << 20], 30)
    order = dedup.by_line(line, lines.words)
    assert np.array_equal(line[order], line)
