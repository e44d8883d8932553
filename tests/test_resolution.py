"""Entity resolution in rounds against the sequential rule: chains, crowds, copies, ties, odd rows."""

import math
import random

import numpy as np
import pytest

from lantern.functions import models
from lantern.operators import neighbours, resolution, tiles
from lantern.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = "name_norm string, lang string, entity_id string, seq long, embedding array<float>"
KNOWN = "entity_id string, name_norm string, lang string, embedding array<float>"


def at_cosine(c):
    return [c, math.sqrt(1 - c * c)]


def plain(names, known, threshold):
    """One name after the other. names: (name_norm, lang, entity_id, seq, embedding), known: (entity_id, name_norm, lang, embedding)."""
    keys = {(n, lang): e for e, n, lang, _ in known}
    made, out = [], {}

    def unit(v):
        if v is None or not all(map(math.isfinite, v)) or not any(v):
            return None
        v = np.asarray(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    for e, _, _, v in sorted(known, key=lambda k: k[0]):
        made.append((e, unit(v)))
    for name, lang, e, _, v in sorted(names, key=lambda n: (n[3], n[2])):
        if not name or (name, lang) in out:
            continue
        if (name, lang) in keys:
            out[name, lang] = (keys[name, lang], False)
            continue
        u, best = unit(v), (threshold - 1e-12, None)
        for other, w in made:
            if u is not None and w is not None and len(u) == len(w):
                s = round(float(u @ w), 9)
                if s > best[0]:
                    best = (s, other)
        if best[1] is None:
            made.append((e, u))
        out[name, lang] = (best[1] or e, best[1] is None)
    return out


def got(spark, names, known, threshold, **options):
    frame = spark.createDataFrame(names, NAMES).repartition(3)
    rows = resolution.resolve_entities(frame, spark.createDataFrame(known, KNOWN), threshold, **options).collect()
    found = {(r.name_norm, r.lang): (r.entity_id, r.made) for r in rows}
    assert len(found) == len(rows)
    return found


def test_entities_are_resolved_in_order(spark):
    known = [("k1", "nato", "en", [1.0, 0.0])]
    names = [("nato", "en", "n1", 1, [0.0, 1.0]), ("нато", "ru", "n2", 2, at_cosine(0.93)), ("norge", "no", "n3", 3, at_cosine(0.5)), ("norway", "en", "n4", 4, at_cosine(0.5)), ("x", "en", "n5", 5, None), ("", "en", "n6", 6, None), ("x", "en", "n7", 7, None)]
    expected = {("nato", "en"): ("k1", False), ("нато", "ru"): ("k1", False), ("norge", "no"): ("n3", True), ("norway", "en"): ("n3", False), ("x", "en"): ("n5", True)}
    assert got(spark, names, known, 0.92) == expected == plain(names, known, 0.92)


def world(seed, n, dims, spread):
    """Names in clusters of any density, with copies of vectors in other languages, odd vectors and some known ones."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    vectors = []
    for i in range(n):
        if vectors and rng.random() < 0.15:
            vectors.append(rng.choice(vectors))
        else:
            vectors.append([x + rng.gauss(0, spread * rng.choice([0.1, 1, 1])) for x in rng.choice(centres)])
    vectors[3], vectors[5], vectors[7], vectors[8] = None, [0.0] * dims, [math.nan] * dims, [1.0, 2.0]
    order = list(range(n))
    rng.shuffle(order)
    names = [(f"n{i}", rng.choice(["en", "no"]), f"e{i:04d}", order[i] // 2, vectors[i]) for i in range(n)]  # pairs of equal seq
    known = [(f"k{i}", f"n{n - 1 - i}" if i % 2 else f"old{i}", rng.choice(["en", "no"]), vectors[n - 1 - i]) for i in range(20)]
    return names + names[:30], known


@pytest.fixture
def rounds(monkeypatch):
    """Rounds of joins to the end, however few edges are left."""
    monkeypatch.setattr(resolution, "FEW", 0)


@pytest.mark.parametrize("seed, dims, spread, threshold", [(1, 3, 0.3, 0.92), (2, 6, 0.4, 0.9), (3, 16, 0.75, 0.8)])
@pytest.mark.parametrize("head", [0, 4, 1024])
def test_rounds_equal_the_rule(spark, seed, dims, spread, threshold, head, monkeypatch, rounds):
    monkeypatch.setattr(resolution, "HEAD", head)
    monkeypatch.setattr(tiles, "MOST_ROWS", 37)  # several tiles
    names, known = world(seed, 260, dims, spread)
    log = []
    assert got(spark, names, known, threshold, log=log) == plain(names, known, threshold)
    assert len(log) <= 12 and (head == 1024) == (not log)


def test_bands_find_the_same(spark):
    names, known = world(4, 200, 8, 0.3)
    assert got(spark, names, known, 0.9, recall=0.9999) == plain(names, known, 0.9)


def test_a_chain_is_settled_link_by_link(spark, monkeypatch, rounds):
    """Each name is near the ones next to it only: every other one makes an entity. The worst case for the rounds."""
    monkeypatch.setattr(resolution, "HEAD", 0)
    step = 0.2
    names = [(f"n{i}", "en", f"e{i:02d}", i, [math.cos(step * i), math.sin(step * i)]) for i in range(15)]
    log = []
    assert got(spark, names, [], math.cos(step * 1.5), log=log) == plain(names, [], math.cos(step * 1.5))
    assert len(log) == 7  # one round for each entity but the last


def test_random_order_takes_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = {tuple(sorted(rng.integers(0, 20_000, 2).tolist(), reverse=True)) for _ in range(40_000)}
    pairs = [p for p in pairs if p[0] != p[1]]
    log, edges = [], neighbours.checkpointed(spark.createDataFrame(pairs, "later long, earlier long"))
    at_once = {r.rank for r in resolution.settled(edges).collect()}
    monkeypatch.setattr(resolution, "FEW", 0)
    followers = {r.rank for r in resolution.settled(edges, log).collect()}
    earlier = {}
    for later, first in pairs:
        earlier.setdefault(later, []).append(first)
    expected = set()
    for node in range(20_000):
        if any(e not in expected for e in earlier.get(node, ())):
            expected.add(node)
    assert followers == expected == at_once
    assert len(log) <= 16 and log == sorted(log, reverse=True)


def test_empty_tables(spark):
    assert got(spark, [], [], 0.9) == {}
    assert got(spark, [("a", "en", "e", 1, None)], [], 0.9) == {("a", "en"): ("e", True)}


def test_items_are_linked_from_text_to_entity(spark):
    """Found, cleared of noise, resolved in the items' order, linked; an item whose model fails links nothing."""
    answers = {"NATO in Oslo": '```[{"name": "NATO", "type": "ORG"}, {"name": "Oslo", "type": "city"}, {"name": "cw.no", "type": "ORG"}]```', "nato again": '[{"name": "nato", "type": "ORG"}, {"name": "GitHub"}]', "НАТО": '[{"name": "НАТО", "type": "ORG"}]'}
    rows = [("i1", 1, "NATO in Oslo", "", "en"), ("i2", 2, "nato again", None, None), ("i3", 3, "НАТО", "", "ru"), ("i4", 4, "broken", "", "en")]
    items = spark.createDataFrame(rows, "item_id string, ts int, title string, summary string, lang string")

    @models.entity_finder
    def find(text):
        return answers[text.strip()]

    vectors = {"nato": [1.0, 0.0], "нато": [0.99, 0.05], "oslo": [0.0, 1.0]}
    made, links = resolution.link_items(items, spark.createDataFrame([], KNOWN), find, models.embedder(lambda name: vectors[name]))
    assert sorted((r.name, r.name_norm, r.lang, r.type) for r in made.collect()) == [("NATO", "nato", "en", "ORG"), ("Oslo", "oslo", "en", "MISC")]
    ids = {r.name: r.entity_id for r in made.collect()}
    assert sorted((r.entity_id, r.item_id, r.mention, r.lang) for r in links.collect()) == sorted([(ids["NATO"], "i1", "NATO", "en"), (ids["Oslo"], "i1", "Oslo", "en"), (ids["NATO"], "i2", "nato", "en"), (ids["NATO"], "i3", "НАТО", "ru")])


def test_backends_by_name(spark):
    backends = {"local": lambda prompt, tokens: f"{prompt}:{tokens}", "heavy": lambda prompt, tokens: f"{prompt}/{tokens}"}
    frame = spark.createDataFrame([("p",)], "p string")
    assert [frame.select(models.synthesizer(backends, n, t)("p")).first()[0] for n, t in (("local", 800), ("heavy", 800), ("heavy", 9000))] == ["p:800", "p/4096", "p/9000"]
    with pytest.raises(ValueError, match="heavy, local"):
        models.synthesizer(backends, "other")


def test_the_query_has_no_task_for_everything(spark):
    plan = catalogue.entity_resolution_fold(spark, SF)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
