"""Pairs of similar vectors by hashing, each verified by its exact cosine.

The sides of random hyperplanes that a vector lies on are its bits. Two vectors at cosine s agree in
a bit with a probability of 1 - acos(s) / pi, so that `bits` of them make a band and the number of
bands gives the wanted recall at the threshold; pairs that are more alike are found more often
still. Only vectors that share a band are compared, and what is returned has been compared exactly.
"""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bands a vector has at most, and bits a band has at most.
MOST_BANDS, MOST_BITS = 96, 28
#: Share of the pairs at the threshold that are found, by the number of bands.
RECALL = 0.9999
#: Rows of one key that one task compares with; a key with more is cut into pieces.
PIECE = 2000
_SEED = 20240101


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lantern-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the folder in `spark.checkpoint.dir` (see `shared_folder`) and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shape(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits): the longest bands of which MOST_BANDS or fewer give the recall."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold must be in (0, 1] and the recall in (0, 1)")
    agree = 1 - math.acos(threshold) / math.pi
    for bits in range(MOST_BITS, 0, -1):
        missed = 1 - agree**bits
        bands = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if bands <= MOST_BANDS or bits == 1:
            return bands, bits
    raise AssertionError


@functools.lru_cache(maxsize=8)
def _planes(dimensions: int, n: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dimensions]).standard_normal((dimensions, n))


def band_keys(threshold: float, recall: float = RECALL):
    """A function of a column of vectors that gives their bands (array of longs); null for null, empty and zero vectors."""
    bands, bits = shape(threshold, recall)

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        lengths = np.array([0 if v is None else len(v) for v in vectors])
        for length in set(lengths.tolist()) - {0}:
            places = np.flatnonzero(lengths == length)
            matrix = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in places])
            sides = (matrix @ _planes(length, bands * bits) > 0).reshape(len(places), bands, bits)
            packed = sides @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(bands, dtype=np.int64) << 32)
            for place, row, vector in zip(places, packed, matrix):
                out[place] = row if vector.any() else None
        return pd.Series(out)

    return keys


def candidates(later: DataFrame, earlier: DataFrame, condition: Column, key: list[str]) -> DataFrame:
    """(later, earlier): distinct pairs that share `key` and meet `condition`.

    The sides have `_l_id` and `_e_id`. A key with more than PIECE rows on the earlier side is dealt
    to several tasks: its rows there by their id, and a copy of the later ones to each piece.
    """
    crowded = earlier.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PIECE)
    crowded = crowded.select(*key, F.ceil(F.col("_n") / PIECE).cast("int").alias("_pieces"))
    dealt = earlier.join(crowded, key, "left").withColumn("_piece", F.pmod(F.xxhash64("_e_id"), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copied = later.join(crowded, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return copied.join(dealt, [*key, "_piece"]).filter(condition).select(F.col("_l_id").alias("later"), F.col("_e_id").alias("earlier")).distinct()
