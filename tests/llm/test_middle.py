"""Fill-in-middle: cuts against plain slicing, forms and markers, restoring, odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.llm import middle

MIXED = st.text(st.sampled_from("ab1 2\n.-<>PSMåØ…€漢😀́"), max_size=120)


def pieces(text, units):
    """Units of a text, character by character."""
    steps = {"l": units.letters, "d": units.digits, "s": units.spaces, "o": units.others}
    kind = lambda c: "l" if c.isascii() and c.isalpha() or ord(c) > 127 else "d" if c in "0123456789" else "s" if c in " \t\n\x0b\f\r" else "o"
    out, last = [], None
    for c in text:
        here = (kind(c), len(c.encode()))
        step = steps[here[0]]
        if last != here or step and len(out[-1]) >= step:
            out.append(c)
        else:
            out[-1] += c
        last = here
    return out


@settings(max_examples=300, deadline=None)
@given(MIXED, st.sampled_from([middle.CODE_POINTS, middle.PIECES, middle.Units(4, 2, 1, 3)]), st.sampled_from([1 << 20, 5]))
def test_offsets_of_all_cuts(text, units, segment):
    data, parts = text.encode(), pieces(text, units)
    held, middle._SEGMENT = middle._SEGMENT, segment
    try:
        runs = middle.encode(data, units)
    finally:
        middle._SEGMENT = held
    assert runs.n == len(parts)
    assert [runs.offset(i) for i in range(runs.n + 1)] == [len("".join(parts[:i]).encode()) for i in range(len(parts) + 1)]


def test_runs_are_maximal():
    runs = middle.encode("abcåæøde".encode())
    assert runs.starts.tolist() == [0, 3, 9] and runs.before.tolist() == [0, 3, 6] and runs.widths.tolist() == [1, 2, 1] and runs.n == 8
    assert middle.encode(b"").offset(0) == 0
    assert middle.encode(b"\x80ab\xff").offset(1) == 1  # bytes that are no UTF-8 go with what is before them


def plain(doc_id, text):
    """The contract, on code points."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(3))
def test_against_slicing(spark, seed):
    texts = [None, "", " ", "a", "å", "😀", "<P>", "a<S", "<<S>", "<M><P>", "x" * 70_000 + "漢" * 70_000, "tail<", "<P", "S>", "M>a<"] + ["".join("abå漢😀\n<>PSM1"[(i * k + seed) % 12] for k in range(i)) for i in range(200)]
    rows = [(i + 1000 * seed, t, i, "s") for i, t in enumerate(texts)] + [(None, "null id", 1, "s"), (None, "null id", 1, "s"), (7, "again", 2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long, form string")
    got = middle.fill_in_middle(frame).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got])) == sorted(map(str, [(i, *plain(i, t), t or "") for i, t, *_ in rows]))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_markers_met_across_cuts(spark):
    """Halves of markers at the ends of parts don't mislead the reader."""
    rows = [(f"{p}{m}{s}", f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}") for p in ("", "<", "<S", "S>") for s in ("", "<M", ">", "P><") for m in ("", "<P", "M>")]
    rows = [r for r in rows if not any(marker in r[0] for marker in ("<P>", "<S>", "<M>"))]
    assert len(rows) > 30
    frame = spark.createDataFrame(rows, "text string, psm string, spm string")
    for form in ("psm", "spm"):
        assert frame.filter(middle.restored(F.col(form), F.lit(form)) != F.col("text")).isEmpty()


def test_pieces_cut_between_words(spark):
    rule = middle.Rule(transformed=100, units=middle.PIECES)
    frame = spark.createDataFrame([(i, "one two 12345 three.") for i in range(40)], "doc_id long, text string")
    for r in middle.fill_in_middle(frame, rule).collect():
        assert r.n == 9 and set(r.output.replace("<P>", "|").replace("<S>", "|").replace("<M>", "|").split("|")) <= {"".join(["one", " ", "two", " ", "123", "45", " ", "three", "."][a:b]) for a in range(10) for b in range(a, 10)}


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
