"""Greedy clusters in independent parts: against one fold over all, in windows, and what the parts are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import aggregates, folds, ordering, tiles
from lantern.plans import catalogue, derive, records

SF = "/root/testdata/sf0.001"


def one_fold(items, threshold=None, least=2):
    """(item_id, cluster, place) of one section: items as (item_id, score, vector or words), one after the other."""
    clusters, out = [], []
    for place, (item_id, _, value) in enumerate(sorted(items, key=lambda i: (-(i[1] or 0), i[0]))):
        best, found = None, None
        for n, members in enumerate(clusters):
            if threshold is None:
                if len(set().union(*(m or () for m in members)) & set(value or ())) >= least:
                    found = n
                    break
            elif value is not None and members[0] is not None:
                mean = np.mean(np.array(members, float), axis=0)
                lengths = np.linalg.norm(mean) * np.linalg.norm(value)
                distance = 1.0 if lengths == 0 else 1 - float(mean @ np.array(value)) / lengths
                if distance < (1 - threshold if best is None else best):
                    best, found = distance, n
        if found is None:
            found = len(clusters)
            clusters.append([])
        clusters[found].append(value)
        out.append((item_id, found, place))
    return sorted(out)


def sections(rows):
    found = {}
    for r in rows:
        found.setdefault(r.ccir, []).append((r.item_id, r.cluster, r.place))
    return {k: sorted(v) for k, v in found.items()}


def plain_sections(items, **options):
    found = {}
    for ccir, *item in items:
        found.setdefault(ccir, []).append(item)
    return {k: one_fold(v, **options) for k, v in found.items()}


@pytest.mark.parametrize("seed, threshold, topics", [(1, 0.75, 6), (2, 0.9, 3), (3, 0.5, 8), (4, 0.35, 1)])
def test_centroids_in_parts(spark, seed, threshold, topics, monkeypatch):
    monkeypatch.setattr(tiles, "MOST_ROWS", 23)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(topics)]
    items = []
    for i in range(220):
        v = [c * rng.choice([0.2, 1, 5]) + rng.gauss(0, 0.45) for c in rng.choice(centres)]
        v = None if i % 31 == 0 else [0.0] * 12 if i % 37 == 0 else v
        items.append((rng.choice(["a", "b", None]), f"i{i:03d}", rng.choice([None, 1, 5, 9]), v))
    frame = spark.createDataFrame(items, "ccir string, item_id string, score int, embedding array<double>").repartition(5)
    assert sections(folds.greedy_centroids(frame, threshold).collect()) == plain_sections(items, threshold=threshold)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keywords_in_parts(spark, seed):
    rng = random.Random(seed)
    items = []
    for i in range(250):
        topic = rng.randrange(15)
        words = [f"t{topic}w{rng.randrange(6)}" for _ in range(rng.randint(0, 3))] + [f"own{i}"] + ["the"] * (i % 2)
        items.append((rng.choice(["a", "b"]), f"i{i:03d}", rng.choice([None, 1, 5, 9]), None if i % 40 == 0 else words))
    frame = spark.createDataFrame(items, "ccir string, item_id string, score int, words array<string>").repartition(5)
    assert sections(folds.greedy_keywords(frame).collect()) == plain_sections(items)


def test_parts_that_never_meet_are_folds_of_their_own(spark):
    rows = spark.createDataFrame([(0, "a", ["x", "y", "q"]), (1, "a", ["x", "y"]), (2, "a", ["u", "v"]), (3, "a", ["u", "v", "q"]), (4, "a", ["q"]), (5, "b", ["x", "y"])], "rank long, ccir string, words array<string>")
    links = folds._word_links(rows, ["ccir"], 2)
    # "q" alone holds 0 and 3 together, as any word shared by two items of a part might.
    assert {(r.node, r.root) for r in ordering.components(links).collect()} == {(n, 0) for n in range(4)}
    fewer = rows.filter("rank <> 3")
    # Without 3, "u" and "v" are only 2's and "q" is left to 0 and 4, which has nothing else: 2 and 4 are alone.
    assert {(r.node, r.root) for r in ordering.components(folds._word_links(fewer, ["ccir"], 2)).collect()} == {(0, 0), (1, 0)}


def test_windows_from_items_to_clusters(spark):
    sf = "/root/testdata/sf0.01"
    got = records.cluster_windows(spark, sf).collect()
    since = records.NOW - 240 * 3600
    items = derive.enriched(spark, sf).join(derive.item_embeddings(spark, sf).select("item_id", "embedding"), "item_id", "left")
    held = {}
    for r in items.filter((F.unix_seconds("created_at") >= since) & F.upper("ccir").isin("FFIR-1", "PIR-3", "PIR-1")).select("ccir", F.unix_seconds("created_at").alias("at"), "item_id", "score", "embedding").collect():
        held.setdefault((r.ccir, (r.at - since) // (24 * 3600)), []).append((r.item_id, r.score, r.embedding))
    expected = sorted((s, w, *row) for (s, w), rows in held.items() for row in one_fold(rows, derive.TEST_SIMILARITY))
    assert sorted((r.section, r.window, r.item_id, r.cluster, r.place) for r in got) == expected and len(held) > 5


def test_three_branches(spark):
    rows = [("a", "x", 9, "oil price rises sharply", [1.0, 0.0]), ("a", "y", 8, "sharply oil price falls", [0.0, 1.0]), ("a", "z", 7, "football", [1.0, 0.1])]
    items = spark.createDataFrame(rows, "ccir string, item_id string, score int, title string, embedding array<double>")
    numbers = lambda df: [r.cluster for r in df.orderBy("item_id").collect()]
    assert numbers(aggregates.clustered(items.withColumn("cluster", F.lit(4)))) == [4, 4, 4]
    assert numbers(aggregates.clustered(items)) == [0, 1, 0]
    assert numbers(aggregates.clustered(items, threshold=7.0)) == [0, 1, 0]
    assert numbers(aggregates.clustered(items.drop("embedding"))) == [0, 0, 1]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbers(spark, groups):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(10_000), 3000)]
    frame = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = {(r.g, r.i): r.n for r in ordering.numbered(frame, groups, ["i"], "n").collect()}
    expected = {}
    for g in {r[0] for r in rows} if groups else [...]:
        for n, row in enumerate(sorted((r for r in rows if g is ... or r[0] == g), key=lambda r: r[1])):
            expected[row] = n
    assert got == expected


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(ordering, "FEW", few)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and root[u] != root[v]:
                root[u] = root[v] = min(root[u], root[v])
                changed = True
    got = {r.node: r.root for r in ordering.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
    assert ordering.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cluster_query_equals_the_plain_fold(spark):
    items = derive.enriched(spark, SF).filter("ccir <> 'none'").select("ccir", "item_id", "score", "title")
    words = items.withColumn("words", catalogue.text.keywords("title")).collect()
    assert sections(catalogue.cluster_greedy_keyword(spark, SF).collect()) == plain_sections([(r.ccir, r.item_id, r.score, r.words) for r in words])


def test_digest_orders_clusters_of_sections(spark):
    words = {"a": "harbour strike ends", "b": "harbour strike grows", "c": "bridge opens today", "d": "harbour strike again"}
    rows = [
        ("1", "PIR-1", words["a"], 7, "x", "I"), ("2", "PIR-1", words["b"], 9, "y", "II"), ("3", "PIR-1", words["c"], 9, "x", None),
        ("4", "PIR-1", words["d"], None, "z", "I"), ("5", "FFIR-2", None, None, None, None), ("6", None, words["a"], 8, "x", "I"),
    ]
    items = spark.createDataFrame(rows, "item_id string, ccir string, title string, score int, source string, cnr string")
    sections = F.array_compact(F.array("ccir", F.when(F.col("cnr") == "I", "CNR")))
    found = {(r.section, r["rank"]): (r.lead, r.size, r.sources, r.max_score, r.urgent) for r in aggregates.digest(items, sections).collect()}
    assert found == {
        ("PIR-1", 1): ("2", 3, ["x", "y", "z"], 9, True), ("PIR-1", 2): ("3", 1, ["x"], 9, False),
        ("CNR", 1): ("6", 3, ["x", "z"], 8, True), ("FFIR-2", 1): ("5", 1, [], 0, False),
    }
    assert aggregates.digest(items, sections, 1).count() == 3 and aggregates.digest(items.limit(0), sections).count() == 0


def test_recall_prompt_without_values(spark):
    from lantern.operators import wiki

    ddl = "cited array<struct<item_id:string,title:string,source:string,ccir:string,score:int,summary:string,body:string>>"
    rows = [([("1", None, "s", "c", 3, "", "é" * 600), ("2", "t", None, None, None, "why", None)],), ([],)]
    told = [r[0] for r in spark.createDataFrame(rows, ddl).select(wiki.recall_prompt(F.lit("q"), F.col("cited"), bodies=True)).collect()]
    body = f"[item_id: 1] Title: unknown Source: s CCIR: c Score: 3\nBody: {'é' * 500}\n[item_id: 2] Title: t Source: unknown CCIR: unknown Score: unknown\nSummary: why"
    assert told[0].endswith("\n\nQuery: q\n\nArticles:\n" + body) and told[1].endswith("Articles:\n")
