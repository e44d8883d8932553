"""Mixing: targets against plain water filling, quotas against one block at a time, odd rows."""

import hashlib

import pytest

from lantern.llm import mixing


def fill(sizes, weights, share, repeats):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    wanted, targets, open_ = sum(sizes) * share / 100, [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (wanted - sum(targets[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > repeats * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = weights[i] * level
            break
        for i in over:
            targets[i] = float(repeats * sizes[i])
        open_ -= over
    return targets


def deal(targets, blocks, most):
    """Sainte-Lague, one block at a time, and no more than `most` to each."""
    seats = [0] * len(targets)
    for _ in range(blocks):
        best = max((i for i in range(len(targets)) if seats[i] < most[i]), key=lambda i: (targets[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 5000, 700, 3, 90, 90], [1, 1, 1000], [640] * 7, [0, 50, 900]])
def test_targets_and_quotas(spark, sizes):
    mix = mixing.Mix(block_tokens=7)
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
    totals = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    rows = mixing.block_quotas(mixing.source_targets(totals, mix), mix).orderBy("ordinal").collect()
    assert [r.source for r in rows] == names
    targets = fill(sizes, [mix.weights[i % 3] for i in range(len(sizes))], mix.share_percent, mix.max_repeats)
    assert [r.target for r in rows] == pytest.approx(targets)
    in_blocks = [r.target * -(-n // 7) / n if n else 0.0 for r, n in zip(rows, sizes)]
    assert [r.quota for r in rows] == deal(in_blocks, round(sum(in_blocks)), [2 * -(-n // 7) for n in sizes])
    shards = mixing.shard_quotas(spark.createDataFrame(rows), mix).collect()
    for r in rows:
        own = [x.blocks for x in shards if x.source == r.source]
        assert sum(own) == r.quota and max(own) - min(own) <= 1
    per_shard = [sum(x.blocks for x in shards if x.shard == h) for h in range(mix.shards)]
    assert max(per_shard) - min(per_shard) <= 1


def test_documents(spark):
    docs = [(i, f"s{i % 5}", "w " * (i * 7 % 300), i) for i in range(600)] + [(1000, None, "a b\tc" * 40, 1), (1001, "s1", None, 1), (1002, "s1", "", 1), (5, "s0", "w " * 35, 5)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, size int")
    rows = mixing.mix_documents(frame).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 16
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(frame.repartition(7)).collect()))
    taken = mixing.take_documents(frame)
    assert taken.columns == frame.columns
    got = taken.groupBy("source").count().count()
    assert got == 6
    assert mixing.mix_documents(frame.limit(0)).count() == 0


def test_shards_take_their_quotas(spark):
    """Every shard gets its quota of blocks of each source, told block by block from the seeded stream."""
    mix = mixing.Mix(block_tokens=7, shards=3)
    docs = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i * 5 % 40)) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sizes = {(d, s): len(t.split()) for d, s, t in docs}
    quota = {r.source: r.quota for r in mixing.mix_documents(frame, mix).collect()}
    expected, dealt = {}, 0
    for source in sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s)):
        own = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d) for d, s, _ in docs if s == source)
        stream = [d for _, d in own for _ in range(sizes[d, source])]
        blocks = -(-len(stream) // 7)
        shards = sorted((dealt + k) % 3 for k in range(quota[source]))
        dealt += quota[source]
        for place, shard in enumerate(shards):
            for d in stream[place % blocks * 7 : place % blocks * 7 + 7]:
                expected[d, source, shard] = expected.get((d, source, shard), 0) + 1
    assert {(r.doc_id, r.source, r.shard): r.taken for r in mixing.mix_shards(frame, mix).collect()} == expected


def test_a_source_smaller_than_a_block_gives_its_words(spark):
    frame = spark.createDataFrame([(1, "tiny", "a b c d e"), (2, "big", "w " * 1000), (3, "big", "v " * 999)], "doc_id long, source string, text string")
    by = {r.doc_id: r for r in mixing.mix_documents(frame, mixing.Mix(weights=(1,))).collect()}
    assert (by[1].target, by[1].taken) == (10.0, 10)
    assert abs(by[2].taken + by[3].taken - by[2].target) <= 16


def test_copies_of_every_row(spark):
    """Copies follow what the mix takes of a row, also where rows share doc_id and size."""
    docs = [(i, f"s{i % 3}", f"{'w ' * (i % 50)}x{i}") for i in range(300)] + [(7, "s1", "w " * 7 + "y"), (None, None, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    taken, copies = {}, {}
    for r in mixing.mix_documents(frame).collect():
        taken.setdefault((r.doc_id, r.source, r.size), []).append(int(r.taken / r.size + 0.5))
    for r in mixing.take_documents(frame).collect():
        copies[r.doc_id, r.source, r.text] = copies.get((r.doc_id, r.source, r.text), 0) + 1
    for key, counts in taken.items():
        got = [copies.get(d, 0) for d in docs if (d[0], d[1], len(d[2].split())) == key]
        assert sorted(copies.get((d[0], d[1], d[2]), 0) for d in docs if (d[0], d[1], len(d[2].split())) == key) == sorted(counts), (key, got)
    assert sum(copies.values()) > 300


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = mixing.op4_mix(spark, sf).collect()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.01)
