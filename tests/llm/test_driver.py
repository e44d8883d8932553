"""What the driver is asked for doesn't grow with the number of shuffle partitions."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import linededup, neardup, shared

PARTITIONS = 40


@pytest.fixture
def dealt(spark):
    """Shuffles into many partitions, none of them merged."""
    names = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def jobs(spark, work):
    """What `work` returns, and how many jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_come_by_few_jobs(dealt):
    hashes = dealt.range(5000).select(F.xxhash64("id").alias("h"))
    bits, started = jobs(dealt, lambda: shared.bitmap(hashes, "h"))
    values = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    assert started < 10 and shared.may_hold(bits, values).all()
    assert sum(int(w).bit_count() for w in bits.view(np.uint64)) == len(set((values >> np.uint64(65 - (64 * len(bits)).bit_length())).tolist()))
    assert not shared.bitmap(hashes.limit(0), "h").any()

    rng = np.random.default_rng(5)
    grams = [rng.integers(0, 1 << 62, 400, np.int64).view(np.uint64) for _ in range(20)] + [np.full(9, 77, np.uint64)]
    sets = dealt.createDataFrame([(bytearray(g.tobytes()),) for g in grams], "grams binary")
    ranks, started = jobs(dealt, lambda: neardup._rarity(sets))
    total = np.bincount(neardup._rarity_bucket(np.concatenate(grams)), minlength=1 << neardup.RARITY_BITS)
    assert started < 10 and (ranks[np.argsort(total, kind="stable")] == np.arange(len(total))).all()

    scan = dealt.createDataFrame([(None, k, n) for k, n in enumerate(rng.integers(1, 9, 500).tolist())] + [(1, 600, 5)], "line_no int, key long, n long")
    ranks, started = jobs(dealt, lambda: linededup._counts(scan))
    total = np.zeros(1 << linededup.COUNT_BITS, np.int64)
    total[[r.key for r in scan.collect() if r.line_no is None]] = [r.n for r in scan.collect() if r.line_no is None]
    assert started < 10 and (ranks[np.argsort(total, kind="stable")] == np.arange(len(total))).all()
