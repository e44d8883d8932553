"""Product quantisation of vectors: integer codebooks by Lloyd's rounds, with exact nearest entries.

Each vector becomes integers and is cut into parts; a part is replaced by the number of the nearest
entry of its codebook. Distances are exact integers, and of equal ones the lower entry counts, so
results don't depend on hardware or on how rows are dealt. Evaluating all entries in 64-bit integers
would be slow; the products of parts and entries are therefore taken by a float32 matrix product
first. The rounding error of a product of k factors, in whatever order they are summed, is at most
gamma(k) times the product of lengths; that gives each entry's distance an interval. Every entry
whose interval reaches down to the least upper end is evaluated again in int64.

Sums and counts of each round are made by the tasks, one row an entry, and brought together in Spark;
the driver sees codebooks only, whose size doesn't depend on the table's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

#: Half the distance from 1 to the next float32: the relative error of one rounding.
UNIT = 2.0**-24
#: Vectors and pairs of vector and entry that are compared at a time.
_ROWS, _PAIRS = 2048, 1 << 17


@dataclass(frozen=True)
class Coding:
    """`parts` codebooks of `entries` (256 at most) entries, `rounds` of Lloyd's, components times `scale`, floored."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024

    def __post_init__(self) -> None:
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("a code has 1 to 256 entries, one part at least and no negative rounds")


def intervals(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, radius) of intervals that hold the squared distances less the parts' own squares.

    With conversion to float32, a product of d components has d + 2 roundings a term at most. The terms
    with 2**-50 and 2**-49 cover what is computed in float64 here and when the ends are compared.
    """
    k = parts.shape[1] + 2
    gamma = k * UNIT / (1 - k * UNIT)
    product = (parts.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    squares = np.square(entries).sum(axis=1).astype(np.float64)
    lengths = np.sqrt(np.square(parts).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)
    middle = squares - 2 * product
    return middle, lengths * (2 * gamma * (1 + 2.0**-40) + 2.0**-49) + squares * 2.0**-50


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest of `entries` for each of `parts` (int64 both), the lower one of equals."""
    # Of equal entries only the first can win.
    firsts = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    kept = entries[firsts]
    chosen, least = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for start in range(0, len(parts), _ROWS):
        block = parts[start : start + _ROWS]
        middle, radius = intervals(block, kept)
        row, column = np.nonzero(middle - radius <= (middle + radius).min(axis=1)[:, None])
        distance = np.empty(len(row), np.int64)
        for low in range(0, len(row), _PAIRS):
            at = slice(low, low + _PAIRS)
            distance[at] = np.square(block[row[at]] - kept[column[at]]).sum(axis=1)
        begins = np.flatnonzero(np.diff(row, prepend=-1))  # every row has an entry
        best = np.minimum.reduceat(distance, begins)
        hit = np.flatnonzero(distance == best[row])
        hit = hit[np.diff(row[hit], prepend=-1) > 0]  # columns rise within a row
        chosen[start : start + _ROWS] = firsts[column[hit]]
        least[start : start + _ROWS] = best
    return chosen, least


def _integers(column: pa.Array, coding: Coding, dims: int | None) -> np.ndarray:
    """The vectors of an Arrow list column as a matrix of integers."""
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths[0]) if dims is None else dims
    if (lengths != width).any():
        raise ValueError(f"vectors have different lengths: {width} and {int(lengths[lengths != width][0])}")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * coding.scale).reshape(-1, width)
    if len(scaled) and width * (2 * max(1.0, float(np.abs(scaled).max()))) ** 2 >= 2.0**62:
        raise ValueError("vector components are too large for squared distances of 64 bits")
    return scaled.astype(np.int64)


def _kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def _assigned(matrix: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, distances) of every row and part."""
    width = books.shape[2]
    found = [nearest(np.ascontiguousarray(matrix[:, p * width : (p + 1) * width]), books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _next_books(kept: DataFrame, books: np.ndarray, coding: Coding) -> np.ndarray:
    """The codebooks after one round: each used entry becomes the floored mean of its parts."""
    count, width = books.shape[1:]
    dims = len(books) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        sums, counts = np.zeros((len(books) * count, width), np.int64), np.zeros(len(books) * count, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                matrix = _integers(batch.column(0).slice(start, _ROWS), coding, dims)
                entries, _ = _assigned(matrix, books)
                for p in range(len(books)):
                    place = p * count + entries[:, p]
                    np.add.at(sums, place, matrix[:, p * width : (p + 1) * width])
                    counts += np.bincount(place, minlength=len(counts))
        used = np.flatnonzero(counts)
        if len(used):
            yield {"place": used, "n": counts[used], "sums": sums[used].tolist()}

    made = arrow.map_batches(kept.select("embedding"), run, "place int, n long, sums array<long>")
    total = made.groupBy("place").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy().reshape(-1, width)
    for row in total.collect():  # a row an entry at most
        out[row.place] = np.array(row.sums, np.int64) // row.n
    return out.reshape(books.shape)


def first_books(kept: DataFrame, coding: Coding) -> np.ndarray | None:
    """The parts of the vectors with the smallest vec_ids, as codebooks; None for an empty table."""
    rows = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(coding.entries).collect()
    if not rows:
        return None
    matrix = _integers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), coding, None)
    if matrix.shape[1] % coding.parts:
        raise ValueError(f"vectors of {matrix.shape[1]} components can't be cut into {coding.parts} equal parts")
    return np.ascontiguousarray(matrix.reshape(len(rows), coding.parts, -1).transpose(1, 0, 2))


def codebooks(vectors: DataFrame, coding: Coding = Coding()) -> np.ndarray | None:
    """int64 codebooks [part, entry, position] fitted to all of `vectors` (vec_id, embedding); None without any vector."""
    kept = _kept(vectors)
    books = first_books(kept, coding)
    for _ in range(coding.rounds if books is not None else 0):
        books = _next_books(kept, books, coding)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, coding: Coding = Coding()) -> DataFrame:
    """vec_id and label of `vectors`, code (two hexadecimal digits a part) and error (squared distances summed)."""
    kept = _kept(vectors).select("vec_id", "label", "embedding")
    schema = arrow.schema(kept.schema["vec_id"], kept.schema["label"], "code string, error long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                entries, distances = _assigned(_integers(part.column(2), coding, books.shape[0] * books.shape[2]), books)
                codes = [row.tobytes().hex() for row in entries.astype(np.uint8)]
                yield {"vec_id": part.column(0), "label": part.column(1), "code": codes, "error": distances.sum(axis=1)}

    return arrow.map_batches(kept, run, schema)


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in decimals, by part, entry and position, joined by commas."""
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def _group(label: Column) -> Column:
    """A key for equal labels, nulls together."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def compressed(vectors: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows of `vectors` (vec_id, embedding, label; other columns are ignored).

    Rows whose vector is null or empty, or has a null or non-finite component, are left out. Codebooks
    start with the smallest vec_ids; null ones come last, and of repeated ones the lesser vector first.
    With fewer vectors than entries the codebooks are shorter. label_error sums the error over equal
    labels, null ones together. Vectors of different lengths, lengths that can't be cut evenly, and
    components whose distances don't fit into 64 bits are refused with a ValueError. An empty table
    gives an empty result.
    """
    books = codebooks(vectors, coding)
    rows = shared.staged(encode(vectors, books, coding).withColumn("_group", _group(F.col("label"))), "codes")
    sums = shared.staged(rows.groupBy("_group").agg(F.sum("error").alias("label_error")), "codes-labels")
    few = shared.small(sums)
    joined = rows.join(few, "_group") if few is not sums else shared.join_hot(rows, sums, "_group")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(shared.table(spark, sf_dir, "embeddings"))


def oracle(coding: Coding = Coding()) -> str:
    """DuckDB SQL for `compressed`: every entry's distance, in doubles that are exact for components of moderate size."""
    n, parts, scale = coding.entries, coding.parts, coding.scale
    steps = []
    for r in range(coding.rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.r, p.part, min(((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))::BIGINT * {n} + c.entry)) AS m
  FROM parts p JOIN c{r} c ON c.part = p.part GROUP BY p.r, p.part
)""")
        if r < coding.rounds:
            steps.append(f"""
n{r} AS (
  SELECT part, entry, list(x ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, floor(sum(x) / count(*)) AS x FROM (
      SELECT p.part, a.m % {n} AS entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS pos FROM a{r} a JOIN parts p ON p.r = a.r AND p.part = a.part) GROUP BY ALL) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n{r}.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} ON n{r}.part = c.part AND n{r}.entry = c.entry
)""")
    last = coding.rounds
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS t(part)
), c0 AS (
  SELECT part, r AS entry, v FROM parts WHERE r < {n}
),{",".join(steps)}, found AS (
  SELECT vec_id, label, string_agg(lower(lpad(to_hex(m % {n}), 2, '0')), '' ORDER BY part) AS code, sum(m // {n})::BIGINT AS error
  FROM a{last} JOIN kept USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) FROM c{last}) AS codebooks_sha256
FROM found"""
