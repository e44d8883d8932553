"""The pipeline against brute force on a small table, and its contract."""


import pytest

import corpus_pipeline
from lantern.llm import catalogue, decontamination, mixing, neardup, quality
from tests.llm.test_decontamination import brute_tiling
from tests.llm.test_neardup import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    good = stages["quality rules"](spark, docs, SF)
    verdicts = {r.doc_id: r.kept for r in quality.judge_documents(docs).collect()}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, kept in verdicts.items() if kept)

    single = stages["minhash near-dedup"](spark, good, SF)
    texts = [(i, rows[i].text) for i in sorted(verdicts) if verdicts[i]]
    expected = {int(c) for d, _, c in components(texts, neardup.Likeness(5, 80))}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == expected and single.count() == len(expected)

    clean = stages["benchmark decontamination"](spark, single, SF)
    items = [decontamination.words_of(r.text).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        doc = decontamination.words_of(text).tolist()
        windows = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        near = [t for t in items if any(tuple(t[i : i + 5]) in windows for i in range(len(t) - 4))]
        return any(sum(brute_tiling(t, doc, 5)) * 100 >= 80 * len(t) for t in near)

    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i in expected if not leaks(rows[i].text)}

    mixed = stages["source mixing"](spark, clean, SF)
    taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix_documents(clean).collect() if r.size}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and copies == {i: n for i, n in taken.items() if n}

    final = stages["sharding"](spark, mixed, SF)
    assert final.count() == sum(copies.values())


def test_run_is_repeatable_and_registered(spark):
    assert list(corpus_pipeline.queries()) == ["pipeline"]
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert one == two and one
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalogue.queries())
    assert numbers == list(range(1, 11))


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_queries_run_on_the_small_tables(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0 or name == "op8_leaks"
