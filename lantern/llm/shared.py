"""Helpers that several corpus operators use: staging, bounded broadcasts, distributed running sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the operators define it; everything else is part of a word.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Where the setting is absent, as in tests, a local master gets a temporary folder of its own;
    a cluster without the setting is refused, since its machines share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/lantern-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="lantern-")
    return _own_folders[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a Parquet table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read and not a recomputation, and makes
    a result that is used twice be computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Mark a staged table for broadcast only if counting it proves that it has few rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: A key is hot when it holds more than this many rows and a thousandth of all.
HOT_ROWS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has one row a key, where a few keys may hold most rows of `left`.

    Rows of hot keys stay where they lie and meet the few rows of `right` that are theirs, at most a
    thousand, by broadcast; the others are joined as usual. `left` is read several times, so it
    should be staged.
    """
    total = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > HOT_ROWS) & (F.col("_n") * 1000 > total)).select(key)
    hot = staged(hot.filter(F.col(key).isNotNull()), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)
    crowded = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return crowded.unionByName(left.join(few, key, "left_anti").join(right, key, how))


def columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever characters their names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def packed(df: DataFrame) -> DataFrame:
    """`df` as one struct `_row`, so that no name of its columns can clash; `select("_row.*")` unpacks it."""
    return df.select(F.struct(*columns(df)).alias("_row"))


def hex_long(text: Column, start: int, digits: int) -> Column:
    """The number that `digits` hexadecimal digits of `text` spell, from 1-based `start`."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def running_sum(df: DataFrame, group: str, chunk: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its group, with no task holding a whole group.

    Rows are ordered by `chunk`, then by the columns `order`. Chunk totals are summed first, a
    window over them gives each chunk's start, and a second window runs inside the chunks only.
    `group` and `chunk` may not be null. `df` is read twice, so stage it when it is costly.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = rows.groupBy(group, "_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, [group, "_chunk"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_chunk", "_value", "_start")
    )


def digest_chunk(digest: str, rows: int) -> Column:
    """The chunk of a row that is ordered by a hexadecimal digest: 4096 of them, or 16 times as many until one has 4096 rows."""
    digits = 3
    while 16**digits * 4096 < rows and digits < 8:
        digits += 1
    return F.substring(digest, 1, digits)


#: A bitmap has 256 bits for each value, but no more than this: 16 MB.
MAX_BITMAP_BITS = 1 << 27


def fetched(df: DataFrame) -> list[np.ndarray]:
    """The columns of `df`, numbers of bounded count, brought to the driver by one job, as arrays and not as rows.

    `toLocalIterator` starts a job for each partition, and the driver keeps what it knows of every job.
    """
    return [column.to_numpy() for column in df.toArrow().columns]


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of bounded size in which the leading bits of every long in `column` are set.

    The rows are brought together as bits in Spark; the driver gets at most 2 million words.
    """
    bits = 1 << 16
    most = min(MAX_BITMAP_BITS, 256 * df.count())
    while bits < most:
        bits *= 2
    place = F.shiftrightunsigned(column, 65 - bits.bit_length())
    words = df.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    places, found = fetched(words.select(F.col("word").cast("int").alias("word"), "bits"))
    out[places] = found
    return out


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned `values` may be in the bitmap."""
    place = values >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[place >> np.uint64(6)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) != 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
