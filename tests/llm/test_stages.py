"""Stages and what else returns documents, on tables with odd rows and with extra columns whose names clash."""

import pytest

import corpus_pipeline
from lantern.llm import decontamination, linededup, mixing, neardup, pii, quality, sharding

EXTRA = ["_id", "_key", "_size", "_row", "_gone", "a.b", "my col", "tick`ed", "kept", "n_words", "size", "item_id", "shard", "line_no", "spans", "_source", "_words"]
PROSE = " ".join(f"word{i}" for i in range(70))
BENCHMARK = "what is the capital of that far land over there"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "en", "a", PROSE), (2, "en", "a", PROSE + " more"), (3, "de", None, None), (None, None, "b", ""), (4, "en", "b", " \n\t"),
        (5, "fr", "b", "x " * 60 + BENCHMARK), (None, "en", "a", PROSE[::-1]), (6, "en", "c", "\n".join([PROSE, PROSE, "own line here"])), (6, "en", "c", "\n".join([PROSE, PROSE, "own line here"])),
    ]
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in EXTRA)
    rows = [(*r, len(r[3] or ""), *[f"{n}{i}" for n in EXTRA]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"doc_id long, lang string, source string, text string, n_chars long, {names}")


def benchmark(spark):
    return spark.createDataFrame([(1, BENCHMARK, "x")], "item_id long, text string, _id string")


RETURNING = {
    "quality": lambda spark, docs: quality.keep_good(docs),
    "near": lambda spark, docs: neardup.keep_one(docs),
    "leaks": lambda spark, docs: decontamination.without_leaks(docs, benchmark(spark)),
    "mix": lambda spark, docs: mixing.take_documents(docs),
    "lines": lambda spark, docs: linededup.without_repeats(docs),
    "pii": lambda spark, docs: pii.redacted(docs),
}
#: Rows of `odd` by their text, as each leaves them.
LEFT = {"quality": [0, 1, 6], "near": [0, 2, 3, 4, 5, 6], "leaks": [0, 1, 2, 3, 4, 6, 7, 8], "lines": list(range(9)), "pii": list(range(9))}


@pytest.mark.parametrize("name", sorted(RETURNING))
def test_columns_and_rows(spark, odd, name):
    out = RETURNING[name](spark, odd)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows, before = [r.asDict() for r in out.collect()], [r.asDict() for r in odd.collect()]
    extra = lambda r: tuple(r[c] for c in EXTRA)
    assert {extra(r) for r in rows} <= {extra(r) for r in before}  # carried along, each with its row
    if name in LEFT:
        told = lambda rs: sorted((str(r["doc_id"]), r["n_chars"]) for r in rs)
        assert told(rows) == told(before[i] for i in LEFT[name])
    assert RETURNING[name](spark, odd.limit(0)).count() == 0


def test_the_last_stage(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 9 and all(0 <= r.shard < 40 for r in rows)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "sharding"
