"""Exact comparison of vectors by matrix products of tiles, dealt over tasks.

Rows are dealt to tiles of a bounded size; a pair of tiles is one row, compared by matrix products of
their pieces in its task. Where only pairs at a threshold are looked for, the rows of a large tile are cut into cells
by the sides of planes that they lie on, and a row is not multiplied with cells that are too far beyond the planes to hold
one; else nothing is skipped. The work grows with the product of the two sides; what is given back is what the
caller keeps of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType, _parse_datatype_string

#: Components of all vectors of a tile, about, and the most rows it has. A pair of tiles is copied to its task, so
#: that what is shuffled falls as tiles grow; there it is cut into pieces of up to PIECE rows, which bound what a product takes.
COMPONENTS, MOST_ROWS, PIECE = 1 << 21, 1 << 17, 4096
#: Tiles that a smaller set is dealt to if they have PIECE rows, left tiles that share a copy of a right one, and bytes of copies for a task
#: (of which some remain empty, so that few have the work of several).
SPREAD, SHARED, TASK_BYTES = 4, 2, 2 << 20
#: Rows of a cell, about, and of a tile that is cut into cells; rows that meet the cells at once, and pairs that are handed on together.
CELL, CELLED, BLOCK, FOUND = 96, 8192, 4096, 1 << 20

Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict]
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict]
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def tiles(rows: DataFrame, section: Column | None = None, also: tuple[str, ...] = (), spread: int = SPREAD, share: int = 1) -> DataFrame:
    """(section, dims, tile, n_tiles, held): `rows` (rank, vector and the numbers in `also`) dealt to tiles by a hash of their rank.

    Only vectors of one section and of equal length share a tile, and only such tiles are compared. There are `spread` tiles
    at least if each has PIECE rows, and none is larger than one of `share` parts of the largest.
    """
    sized = rows.select("rank", "vector", *also, F.size("vector").alias("dims"), (F.lit("") if section is None else section).alias("section"))
    least = F.greatest(F.lit(1), F.least(F.lit(MOST_ROWS), F.lit(COMPONENTS) / F.greatest(F.col("dims"), F.lit(1))) / share)
    counts = sized.groupBy("section", "dims").agg(F.count(F.lit(1)).alias("_n"))
    n_tiles = F.greatest(F.ceil(F.col("_n") / least), F.least(F.lit(spread), F.ceil(F.col("_n") / PIECE)))
    counts = counts.select("section", "dims", n_tiles.cast("int").alias("n_tiles"))
    dealt = sized.join(counts, ["section", "dims"]).withColumn("tile", F.pmod(F.xxhash64("rank"), F.col("n_tiles")).cast("int"))
    return dealt.groupBy("section", "dims", "tile").agg(F.first("n_tiles").alias("n_tiles"), F.collect_list(F.struct("rank", "vector", *also)).alias("held"))


def _packed(tiles_: DataFrame, name: str) -> DataFrame:
    """`tiles_` with `held` as `name`: an array of bytes for the ranks, the vectors and what else there is, by rank. Copies of it are cheap."""
    rest = [f for f in tiles_.schema if f.name != "held"]
    schema = StructType([*rest, StructField(name, ArrayType(BinaryType()))])
    target = to_arrow_schema(schema)

    def pack(held: pa.ListScalar, dims: int) -> list[bytes]:
        fields = {f.name: held.values.field(f.name) for f in held.values.type}
        order = np.argsort(ranks := fields.pop("rank").to_numpy(zero_copy_only=False))
        vectors = fields.pop("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ranks), dims)
        return [ranks[order].tobytes(), vectors[order].tobytes(), *[x.to_numpy(zero_copy_only=False)[order].tobytes() for x in fields.values()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            packed = [pack(held, dims.as_py()) for held, dims in zip(column["held"], column["dims"])]
            yield pa.RecordBatch.from_arrays([*[column[c] for c in target.names[:-1]], pa.array(packed, target.types[-1])], schema=target)

    return tiles_.mapInArrow(run, schema)


def _types(tiles_: DataFrame) -> list[np.dtype]:
    """Types of the numbers that `_packed` makes bytes of."""
    of = {f.name: f.dataType for f in tiles_.schema["held"].dataType.elementType}
    ranks, vectors = of.pop("rank"), of.pop("vector").elementType
    return [np.dtype(to_arrow_type(t).to_pandas_dtype()) for t in (ranks, vectors, *of.values())]


def _matrix(packed: pa.ListScalar, types: list[np.dtype], dims: int) -> tuple[np.ndarray, ...]:
    """(ranks, unit vectors, what else the tile has) of a tile, by rank."""
    ranks, vectors, *also = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed.values, types))
    vectors = vectors.astype(np.float64).reshape(len(ranks), dims)
    return ranks, vectors / np.linalg.norm(vectors, axis=1)[:, None], *also


def _met(left: DataFrame, right: DataFrame, half: bool) -> DataFrame:
    """(dims, left, right, same): packed pairs of tiles of vectors of equal length, dealt over tasks; with `half` each pair comes once."""
    of = lambda rows, name: rows.groupBy("section", "dims").agg(F.first("n_tiles").alias(name))
    pairs = left.select("section", "dims", F.col("tile").alias("_tile"), "held").join(of(right, "_others"), ["section", "dims"])
    copies = pairs.agg(F.sum("_others").alias("n"), F.sum(F.size("held") * (F.col("dims") * 4 + 8) * F.col("_others")).alias("bytes")).first()
    parts = max(1, min(copies.n or 0, left.sparkSession.sparkContext.defaultParallelism), min(4096, (copies.bytes or 0) // TASK_BYTES))
    first = F.col("_tile") if half else F.lit(0)
    pairs = _packed(pairs, "_left").filter(F.col("_others") > first).withColumn("tile", F.explode(F.sequence(first, F.col("_others") - 1))).drop("_others")
    groups = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_mine") / SHARED).cast("int") - 1))
    targets = right.select("section", "dims", "tile", "held").join(of(left, "_mine"), ["section", "dims"])
    targets = _packed(targets, "_right").withColumn("_group", groups).drop("_mine")
    # Dealt out by number, as the few bytes of a pair of tiles say nothing about its work.
    key = ["section", "dims", "tile", "_group"]
    dealt = pairs.withColumn("_group", F.floor(F.col("_tile") / SHARED).cast("int")).repartition(parts, *key)
    return dealt.join(targets.repartition(parts, *key), key).select("dims", "_left", "_right", (F.lit(half) & (F.col("tile") == F.col("_tile"))).alias("_same"))


def compare(left: DataFrame, right: DataFrame, function: Compare, ddl: str, half: bool = False) -> DataFrame:
    """What `function` keeps of each pair of pieces of a `left` and a `right` tile of vectors of equal length (both from `tiles`, staged).

    It gets the ranks, unit vectors and further numbers of both, by rank, and gives equally long arrays for the
    columns of `ddl`. With `half`, both sides are the same and each pair of pieces comes once.
    """
    target = to_arrow_schema(_parse_datatype_string(ddl))
    types, others_types = _types(left), _types(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(0)[i].as_py()
                ours, theirs = _matrix(batch.column(1)[i], types, dims), _matrix(batch.column(2)[i], others_types, dims)
                for s in range(0, len(ours[0]), PIECE):
                    for t in range(s if batch.column(3)[i].as_py() else 0, len(theirs[0]), PIECE):
                        kept = function(*[x[s : s + PIECE] for x in ours], *[x[t : t + PIECE] for x in theirs])
                        yield pa.RecordBatch.from_arrays([pa.array(kept[f.name], type=f.type) for f in target], schema=target)

    return _met(left, right, half).mapInArrow(run, ddl)


def _compare_near(left: DataFrame, right: DataFrame, threshold: float, keep: Keep, ddl: str, half: bool = False) -> DataFrame:
    """What `keep` gives for the pairs whose cosine reaches the threshold, FOUND or so at a time; both sides as in `compare`.

    It gets the ranks of both sides, and of each pair the places there and the cosine. A further number of the left side
    is the cosine that its row's pairs reach besides. With `half` each pair of rows comes once, and no row meets itself.
    """
    target = to_arrow_schema(_parse_datatype_string(ddl))
    types, others_types = _types(left), _types(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column(0)[i].as_py()
                ranks, ours, *least = _matrix(batch.column(1)[i], types, dims)
                others, theirs = _matrix(batch.column(2)[i], others_types, dims)[:2]
                least = np.maximum(threshold, least[0]) if least else np.full(len(ranks), threshold)
                for found in _found(ours, theirs, least, same=batch.column(3)[i].as_py()):
                    kept = keep(ranks, others, *found)
                    yield pa.RecordBatch.from_arrays([pa.array(kept[f.name], type=f.type) for f in target], schema=target)

    return _met(left, right, half).mapInArrow(run, ddl)


#: Cosines are rounded to 9 places, so that the order in which products are summed doesn't decide; what may round up lies within this.
EDGE = 1e-8


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, to 9 places."""
    return np.round(left @ right.T, 9)


def _cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(axes, cuts, order, starts): planes across the axes of the largest variance, and the unit vectors `rows` in the order of their cells.

    A cell's number has a bit for each plane, that of the first axis first; there are few rows or none in some.
    """
    bits = min(rows.shape[1], (len(rows) // CELL).bit_length() - 1) if len(rows) >= CELLED else 0
    sample = rows[:: max(1, len(rows) // 4096)]
    axes = np.linalg.eigh(np.atleast_2d(np.cov(sample.T)))[1][:, ::-1][:, :bits] if bits else np.zeros((rows.shape[1], 0))
    along = rows @ axes
    cuts = np.median(along[:: max(1, len(rows) // 4096)], axis=0)
    cell = (along > cuts) @ (1 << np.arange(bits)[::-1])
    order = np.argsort(cell, kind="stable")
    return axes, cuts, order, np.searchsorted(cell[order], np.arange((1 << bits) + 1))


def _beyond(sides: np.ndarray) -> np.ndarray:
    """(cell, row): squared distance, at the least, of rows from cells; `sides` has how far a row lies above each plane."""
    out = np.zeros((1, sides.shape[1]), np.float32)
    for side in sides:
        out = np.stack((out + np.maximum(side, 0) ** 2, out + np.minimum(side, 0) ** 2), axis=1).reshape(-1, sides.shape[1])
    return out


def _found(left: np.ndarray, right: np.ndarray, least: np.ndarray, places: int = 9, same: bool = False) -> Iterator[Found]:
    """(row, column, cosine to so many places) of the unit vectors where it reaches the row's `least`, FOUND or so at a time.

    Of a row and a vector beyond a plane the squared distance is the sum of both from the plane at least, and planes across
    axes at right angles add up. Rows are multiplied with the cells that may hold a vector as near as `least`, in single precision;
    where that differs from it by no more than `edge`, in double. With `same`, of equal sides, each pair of rows comes once.
    """
    edge = 10.0 ** (1 - places) + (left.shape[1] + 4) * 2.0**-23
    axes, cuts, order, starts = _cells(right)
    columns, bits = right[order].astype(np.float32), len(cuts)
    # Rows of a block lie on the same sides of the first planes, by which cells are taken together to groups.
    high = min(bits // 2, max(0, (len(left) // BLOCK).bit_length() - 1))
    low = bits - high
    axis = 1 << np.arange(high)[::-1]
    group = (left @ axes[:, :high] > cuts[:high]) @ axis
    rows_at = order if same else np.argsort(group, kind="stable")
    ends = np.searchsorted(group[rows_at], np.arange(1, (1 << high) + 1)).tolist()
    blocks = [(g, s, min(s + BLOCK, end)) for g, (start, end) in enumerate(zip([0, *ends], ends)) for s in range(start, end, BLOCK)]
    beyond = ((right[order] @ axes[:, :high] - cuts[:high]) ** 2).astype(np.float32)
    loose: list[tuple[np.ndarray, np.ndarray]] = []  # told in single precision
    held: list[Found] = []
    n = 0

    def settled() -> Found:
        """All pairs so far, and none is left."""
        for i, j in loose:
            for s in range(0, len(i), step := max(1, COMPONENTS // left.shape[1])):
                a, b = i[s : s + step], j[s : s + step]
                value = np.round(np.einsum("ij,ij->i", left[a], right[b]), places)
                near = value >= least[a]
                held.append((a[near], b[near], value[near]))
        out = tuple(map(np.concatenate, zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *held)))
        loose.clear(), held.clear()
        return out

    for g, s, end in blocks:
        at = rows_at[s:end]
        block, wanted = left[at], least[at]
        sides = (block @ axes - cuts).T.astype(np.float32)
        reach = (2 + 2e-5 - 2 * wanted).astype(np.float32)  # more than what rounding makes of it
        limit, single = (wanted - edge).astype(np.float32), block.astype(np.float32)
        from_groups, from_cells = _beyond(sides[:high]), _beyond(sides[high:])
        for h in range(1 << high):
            first, last = starts[h << low], starts[(h + 1) << low]
            near = np.flatnonzero(from_groups[h] <= reach)
            if first == last or not len(near) or same and last <= s:
                continue
            left_h = (reach - from_groups[h]).take(near)
            # Of the group those that are near enough to the planes between.
            between = ((g ^ h) & axis > 0).astype(np.float32)
            of_group = first + np.flatnonzero(beyond[first:last] @ between <= left_h.max())
            columns_h, starts_h = columns.take(of_group, axis=0), np.searchsorted(of_group, starts[h << low : ((h + 1) << low) + 1]).tolist()
            single_h, cells_h = single.take(near, axis=0), from_cells.take(near, axis=1)
            for c in range(1 << low):
                start, end = starts_h[c : c + 2]
                if start == end or same and of_group[end - 1] <= s:
                    continue
                kept = np.flatnonzero(cells_h[c] <= left_h)
                ours, kept = single_h.take(kept, axis=0).T, near.take(kept)
                for t in range(start, end if len(kept) else start, 2 * CELL):
                    places_t = of_group[t : min(end, t + 2 * CELL)]
                    product = columns_h[t : t + len(places_t)] @ ours
                    some = np.flatnonzero(product.max(axis=0) >= limit.take(kept))
                    if not len(some):
                        continue
                    i = kept[some]
                    if len(some) * left.shape[1] > len(places_t) * 4:  # of so many rows all is computed at once
                        value = np.round(right[order[places_t]] @ block[i].T, places)
                        j, k = np.divmod(met := np.flatnonzero(value >= wanted[i]), len(i))
                        value = value.take(met)
                    else:
                        value = None
                        j, k = np.nonzero(product.take(some, axis=1) >= limit[i])
                    i, j = i[k], places_t[j]
                    if same:
                        once = j > i + s
                        i, j, value = i[once], j[once], None if value is None else value[once]
                    n += len(i)
                    if value is None:
                        loose.append((at[i], order[j]))
                    else:
                        held.append((at[i], order[j], value))
                    if n >= FOUND:
                        yield settled()
                        n = 0
    yield settled()


def _near(left: np.ndarray, right: np.ndarray, threshold: float, places: int = 9) -> Found:
    """(row, column, cosine to so many places) where it reaches the threshold."""
    return tuple(map(np.concatenate, zip(*_found(left, right, np.full(len(left), threshold), places))))


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier): the ranks of all pairs of `rows` (tiles, staged) whose cosine reaches the threshold."""

    def keep(ranks: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> dict:
        return {"later": np.maximum(ranks[i], others[j]), "earlier": np.minimum(ranks[i], others[j])}

    return _compare_near(rows, rows, threshold, keep, "later long, earlier long", half=True)


def nearest_before(rows: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """(rank, target, similarity): for each of `rows` the nearest of the `targets` (tiles, staged) of lower rank; the least rank of equals.

    Rows without one at the threshold, and at their own `least` if the tiles have that, are left out. Of FOUND pairs of
    two tiles one row is kept for each row.
    """

    def keep(ranks: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> dict:
        before = others[j] < ranks[i]
        i, j, value = i[before], j[before], value[before]
        order = np.lexsort((j, -value, i))  # of equals the first, which has the least rank
        order = order[np.diff(i[order], prepend=-1) > 0]
        return {"rank": ranks[i[order]], "target": others[j[order]], "similarity": value[order]}

    best = _compare_near(rows, targets, threshold, keep, "rank long, target long, similarity double")
    order = F.struct(-F.col("similarity"), "target")
    return best.groupBy("rank").agg(F.min_by(F.struct("target", "similarity"), order).alias("_b")).select("rank", "_b.target", "_b.similarity")


def nearest_within(rows: DataFrame, targets: DataFrame, threshold: float, span: int) -> DataFrame:
    """(rank, target, similarity to 6 places): for each of `rows` the nearest of the `targets` (tiles with `at`, staged) that came before, up to `span` earlier.

    Of equal times that of the least rank came first; of equally near targets the one with the least rank is
    taken. Of each pair of pieces one row is kept for each row; the caller takes the best of them.
    """

    def keep(ranks: np.ndarray, vectors: np.ndarray, at: np.ndarray, target_ranks: np.ndarray, target_vectors: np.ndarray, target_at: np.ndarray) -> dict:
        i, j, value = _near(vectors, target_vectors, threshold, 6)
        ago = at[i] - target_at[j]
        met = (ago <= span) & ((ago > 0) | (ago == 0) & (target_ranks[j] < ranks[i]))
        i, j, value = i[met], j[met], value[met]
        order = np.lexsort((j, -value, i))
        order = order[np.diff(i[order], prepend=-1) > 0]
        return {"rank": ranks[i[order]], "target": target_ranks[j[order]], "similarity": value[order]}

    return compare(rows, targets, keep, "rank long, target long, similarity double")


def near_forest(rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between ranks of `rows` (tiles, staged) that join all whose cosine reaches the threshold, and no others.

    Of the pairs of two pieces no more are kept than they have rows.
    """

    def keep(left_ranks: np.ndarray, left: np.ndarray, right_ranks: np.ndarray, right: np.ndarray) -> dict:
        i, j, _ = _near(left, right, threshold)
        ranks, place = np.unique(np.concatenate((left_ranks, right_ranks)), return_inverse=True)
        u, v = place[i], place[j + len(left_ranks)]
        top = np.arange(len(ranks))
        while (apart := top[u] != top[v]).any():
            a, b = top[u[apart]], top[v[apart]]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(top, top[top]):
                top = top[top]
        moved = np.flatnonzero(top != np.arange(len(ranks)))
        return {"u": ranks[moved], "v": ranks[top[moved]]}

    return compare(rows, rows, keep, "u long, v long", half=True)


def top_k(rows: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(rank, target, similarity, place): the `k` nearest of the `targets` for each of `rows` (both tiles, staged); of equals the least rank.

    Of each pair of pieces at most k rows are kept for each row.
    """

    def keep(ranks: np.ndarray, vectors: np.ndarray, target_ranks: np.ndarray, target_vectors: np.ndarray) -> dict:
        found = np.round(vectors @ target_vectors.T, 6)
        order = np.argsort(-found, axis=1, kind="stable")[:, :k]  # targets come by rank
        return {"rank": np.repeat(ranks, order.shape[1]), "target": target_ranks[order].ravel(), "similarity": np.take_along_axis(found, order, axis=1).ravel()}

    best = compare(rows, targets, keep, "rank long, target long, similarity double")
    by_place = Window.partitionBy("rank").orderBy(F.col("similarity").desc(), "target")
    return best.withColumn("place", F.row_number().over(by_place)).filter(F.col("place") <= k)
