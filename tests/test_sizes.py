"""What keeps the larger tables within their limits: how often things are compared, shuffled and sent to Python."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.functions import text
from lantern.operators import entities, neighbours, resolution, store, tiles, vectors
from lantern.plans import catalogue, derive

SF = "/root/testdata/sf0.001"


def units(seed, n, dims):
    v = np.random.default_rng(seed).random((n, dims))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_single_precision_only_chooses_what_is_computed(threshold):
    a, b = units(1, 700, 6), units(2, 300, 6)
    i, j, value = tiles._near(a, b, threshold)
    exact = np.round(a @ b.T, 9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact >= threshold))))
    assert np.allclose(value, exact[i, j], atol=1.5e-9, rtol=0)


def test_tiles_are_large_and_cut_to_pieces_in_their_task(spark, monkeypatch):
    assert tiles.MOST_ROWS * 16 <= tiles.COMPONENTS and tiles.MOST_ROWS > 8 * tiles.PIECE  # few copies of small vectors
    monkeypatch.setattr(tiles, "MOST_ROWS", 70)
    monkeypatch.setattr(tiles, "PIECE", 20)
    v = units(3, 150, 4)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "rank long, vector array<double>")
    held = neighbours.checkpointed(tiles.tiles(rows))
    assert held.count() == 4
    got = [tuple(r) for r in tiles.near_pairs(held, 0.95).collect()]
    i, j = np.nonzero(np.round(v @ v.T, 9) >= 0.95)
    assert sorted(got) == sorted((a, b) for a, b in zip(i.tolist(), j.tolist()) if a > b) and got


def test_known_entities_are_compared_once(spark, monkeypatch):
    asked = []
    plain = tiles.nearest_before
    monkeypatch.setattr(tiles, "nearest_before", lambda rows, targets, t: asked.append(targets.agg(F.sum(F.size("held"))).first()[0]) or plain(rows, targets, t))
    names = "name_norm string, lang string, entity_id string, seq long, embedding array<float>"
    fresh = spark.createDataFrame([(f"n{i}", "en", f"e{i:03}", i, x.tolist()) for i, x in enumerate(units(4, 60, 5))], names)
    known = spark.createDataFrame([(f"k{i:03}", f"k{i}", "en", x.tolist()) for i, x in enumerate(units(5, 40, 5))], "entity_id string, name_norm string, lang string, embedding array<float>")
    out = resolution.resolve_entities(fresh, known, 0.97)
    made = out.filter("made").count()
    assert asked == [40, made] and 0 < made < 60


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_links_of_an_item_equal_links(spark):
    rows = [("a", 2, "xx", ["u", "v"]), ("a", 1, "en", ["v", "w", "v"]), ("b", 1, None, ["u"]), ("b", 2, "no", ["u"])]
    writes = spark.createDataFrame(rows, "item_id string, seq int, lang string, links array<string>")
    got = sorted(map(tuple, store.inserted_item_links(writes, ["item_id"]).collect()), key=str)
    flat = writes.select("item_id", "seq", "lang", F.explode("links").alias("mention")).withColumn("entity_id", F.lit("e"))
    assert got == sorted(((r.item_id, r.mention, r.lang) for r in store.inserted_links(flat).collect()), key=str)
    assert "SortAggregate" not in plan(catalogue.queries()["upsert_links"](spark, SF))


def test_near_earlier_needs_no_bands(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "band_keys", lambda *_: pytest.fail("bands are not exact"))
    nan, day = float("nan"), 86400
    rows = [("d", 0, [1.0, 0.0]), ("c", 0, [1.0, 0.0]), ("b", 7 * day, [2.0, 0.0]), ("a", 7 * day + 1, [1.0, 0.1]), ("e", 5, [nan, 1.0]), ("f", 6, None), ("g", 7, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "item_id string, at long, embedding array<double>").withColumn("created_at", F.timestamp_seconds("at"))
    got = {r.item_id: (r.duplicate_of, r.similarity) for r in vectors.near_earlier(frame, 0.9).collect()}
    assert got == {"d": ("c", 1.0), "b": ("c", 1.0), "a": ("b", 0.995037)}


def test_notes_are_counted_before_the_shuffle(spark):
    df = catalogue.queries()["entity_graph_notes"](spark, SF)
    assert "SortAggregate" not in plan(df).split("HashAggregate")[-1] and "hashpartitioning(item_id" not in plan(df)


def test_links_are_counted_before_the_shuffle(spark):
    assert "hashpartitioning(entity_id" not in plan(catalogue.queries()["entities_by_links"](spark, SF))


def test_pairs_of_languages_need_no_distinct_links(spark, monkeypatch):
    monkeypatch.setattr(derive, "entity_links", lambda *_: pytest.fail("links are many, mentions few"))
    assert catalogue.queries()["cross_language_pairs"](spark, SF).columns == ["key", "left", "right"]


def test_links_of_items_are_shuffled_as_arrays(spark):
    df = catalogue.queries()["entity_links_per_item"](spark, SF)
    assert "hashpartitioning(entity_id" not in plan(df)
    words = spark.createDataFrame([("i", "en", ["car"], ["cats", "buss"]), ("i", "en", ["car"], []), ("j", "no", [], ["cats"])], "item_id string, lang string, plain array<string>, other array<string>")
    spelled = spark.createDataFrame([("cat", "en", "cats"), ("cat", "en", "cat"), ("bu", "en", "buss"), ("cat", "no", "cats")], "name_norm string, lang string, mention string")
    got = {r.item_id: [tuple(e) for e in r.entities] for r in entities.of_item_words(words, entities.renamed(spelled)).collect()}
    assert got == {"i": [("buss", "buss", "en"), ("car", "car", "en"), ("cat", "cats", "en")], "j": [("cats", "cats", "no")]}


def test_references_go_to_python_without_their_texts(spark):
    texts = ["&#97;x&ouml;&amp;lt;", "&ampx &x &#38;#97; &notit; &#9 &#97;", "&#0;&#x80;&#xD800;&#1114112;&#;&", "&lt;b&gt;", "&ouml", "&bogus; \U0001f600&eacute;\n&", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.decode_references("t").alias("d")).collect()
    assert [(r.t, r.d) for r in rows] == [(t, None if t is None else html.unescape(t)) for t in texts]
    assert "array" in text._all_references.returnType.simpleString()  # it gets and gives references


def crowds(seed, n, dims):
    """Vectors all over, in crowds, on planes, and copies."""
    rng = np.random.default_rng(seed)
    v = rng.random((n, dims))
    v[: n // 4] = v[rng.integers(0, 5, n // 4)] + rng.normal(0, 0.05, (n // 4, dims))
    v[n // 4 : n // 3] = v[n // 3 : n // 3 + n // 3 - n // 4]
    v[n // 2 : n // 2 + 50, 1:2] = 0
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("dims, threshold", [(1, 0.5), (2, 0.99), (16, 0.97), (16, 0.6), (40, 0.9)])
@pytest.mark.parametrize("found", [30, 1 << 20])
def test_cells_lose_no_pair(dims, threshold, found, monkeypatch):
    for name, value in (("CELL", 8), ("CELLED", 64), ("BLOCK", 32), ("FOUND", found)):
        monkeypatch.setattr(tiles, name, value)
    a, b = crowds(7, 500, dims), crowds(8, 900, dims)
    least = np.maximum(threshold, np.random.default_rng(9).choice([0, 0.98, 1.0], len(a)))
    exact = np.round(a @ b.T, 9)
    got = [x for part in tiles._found(a, b, least) for x in zip(*(c.tolist() for c in part))]
    assert len(got) == len({g[:2] for g in got})
    assert {g[:2] for g in got} == set(zip(*(x.tolist() for x in np.nonzero(exact >= least[:, None]))))
    assert all(abs(exact[i, j] - value) < 1.5e-9 for i, j, value in got)
    once = [tuple(sorted(x)) for part in tiles._found(b, b, np.full(len(b), threshold), same=True) for x in zip(part[0].tolist(), part[1].tolist())]
    i, j = np.nonzero(np.round(b @ b.T, 9) >= threshold)
    assert sorted(once) == sorted((x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y)


def test_most_cells_are_out_of_reach():
    """Of the vectors that stand in for names a row is compared with less than a half."""
    a, b = units(10, 500, 16), units(11, 1 << 16, 16)
    axes, cuts, order, starts = tiles._cells(b)
    away = tiles._beyond((a @ axes - cuts).T.astype(np.float32))
    assert starts[-1] == len(b) and len(away) == len(starts) - 1 >= 512
    assert ((away <= 0.06).T @ np.diff(starts)).mean() < 0.5 * len(b)
    cell = np.searchsorted(starts, np.arange(len(b)), side="right") - 1
    apart = ((a[:20, None] - b[order][None]) ** 2).sum(axis=2)
    assert (away[cell].T[:20] <= apart + 1e-5).all()


def test_rows_look_for_nothing_below_their_least(spark):
    v = units(12, 300, 5)
    rows = spark.createDataFrame([(i, x.tolist(), 0.96 if i % 2 else 1.0) for i, x in enumerate(v)], "rank long, vector array<float>, least double")
    held = neighbours.checkpointed(tiles.tiles(rows, also=("least",)))
    got = {r.rank: r.target for r in tiles.nearest_before(held, held, 0.9).collect()}
    v = v.astype(np.float32).astype(float)
    exact = np.round((v / np.linalg.norm(v, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 9)
    expected = {i: int(np.argmax(exact[i, :i])) for i in range(1, 300) if exact[i, :i].max() >= (0.96 if i % 2 else 1.0)}
    assert got == expected and len(got) > 50


def test_texts_are_read_once_for_their_names(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(resolution, "resolve_entities", lambda *a: asked.extend(a[:2]) or a[0])
    catalogue.queries()["entity_resolution_fold"](spark, SF)
    assert len(asked) == 2 and all("documents" not in str(f.inputFiles()) and "staged-" in str(f.inputFiles()) for f in asked)
    names = derive.entity_names(spark, SF)
    assert sorted(map(tuple, names.collect())) == sorted(map(tuple, derive.entities(spark, SF).select(*names.columns).collect()))
