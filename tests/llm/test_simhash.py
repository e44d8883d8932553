"""SimHash: fingerprints bit by bit, links against all pairs, tiles, odd rows."""

import random

import numpy as np
import pytest
import xxhash

from lantern.llm import shared, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """The least index that each of `prints` reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def plain_result(rows, width=3, radius=2):
    prints = [plain_fingerprint(t, width) for _, t in rows]
    roots, least = plain_components(prints, radius), {}
    for (doc_id, _), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return sorted(map(str, [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots)]))


def test_fingerprints():
    for text in (None, "", " \n\t", "one", "One two", "one two three", "ONE two\x0bTHREE x four", "å Å ß İ 漢 字", "a b c " * 40_000, "x " * 3):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_hash_is_sparks(spark):
    row = spark.range(1).selectExpr("xxhash64('alpha beta gamma') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"alpha beta gamma", 42)


@pytest.mark.parametrize("groups, radius", [(1, 0), (1, 2), (2, 2), (4, 1), (4, 3), (8, 2)])
def test_steps_between_counts(groups, radius):
    steps = {tuple(s) for s in simhash.offsets(groups, radius)}
    rng = random.Random(groups)
    width = 64 // groups
    counts = lambda x: [(x >> g * width & (1 << width) - 1).bit_count() for g in range(groups)]
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, radius)):
            b ^= 1 << rng.randrange(64)
        step = tuple(y - x for x, y in zip(counts(a), counts(b)))
        assert step in steps or tuple(-s for s in step) in steps
    assert not any(tuple(-x for x in s) in steps for s in steps if any(s))


def crowd(seed, n=400):
    """Fingerprints in clusters around a few centres, some of them one step from the edge of all bits or none."""
    rng = random.Random(seed)
    found = {0, 2**64 - 1, 1, 3, 7, 2**63, 2**64 - 2}
    while len(found) < n:
        x = rng.choice([0, 2**64 - 1, 0x0123456789ABCDEF, rng.getrandbits(64)])
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("groups", [1, 2, 4, 8])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_join_what_all_pairs_join(spark, groups, radius, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)  # several tiles a key
    prints = crowd(groups * 10 + radius)
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    classes = shared.staged(spark.createDataFrame(signed, "bits long"), "test")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(classes, radius, groups).collect()]
    assert all(0 < (u ^ v).bit_count() for u, v in links)
    place = {p: i for i, p in enumerate(prints)}
    root = simhash.forest(np.array([place[u] for u, _ in links], int), np.array([place[v] for _, v in links], int), len(prints))
    assert root.tolist() == plain_components(prints, radius)


def test_a_forest_is_no_larger_than_its_nodes():
    centre = 0x5555AAAA5555AAAA
    prints = np.array([centre] + [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64)
    u, v = simhash.linked(prints, prints, 2)
    assert len(u) == len(prints) - 1


def test_group_counts():
    assert [simhash.group_count(n) for n in (0, 1, 16_384, 16_385, 10**6, 10**8, 10**12)] == [1, 1, 1, 2, 4, 8, 8]


def test_documents_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, None), (None, "lone one"), (None, rows[0][1].upper()), (2003, "a b"), (2004, "A\tB"), (2004, "A\tB"), (-3, rows[30][1] + " ")]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, fingerprint string, bits long")
    got = simhash.near_duplicates(frame).collect()
    assert sorted(map(str, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == plain_result(rows)


def test_the_tables_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = simhash.op13_simhash(spark, SF).collect()
    assert sorted(map(str, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == plain_result(rows)


def test_hot_copies_and_empty_table(spark):
    rows = [(i, "same words here again" if i % 3 else "") for i in range(6000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.component_id, r.n) for r in got.groupBy("component_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == [(0, 2000), (1, 4000)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
