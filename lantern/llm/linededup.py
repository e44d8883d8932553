"""Exact set-similarity join of lines, to remove lines that resemble an earlier one.

Lines become sets of word hashes; lines with equal sets form a class, and the join is between
classes. Words are ordered from rare to frequent, by counts of hashed words over all documents.

1. Each class posts the words of its prefix: two sets that reach the threshold share a word there.
   Postings that share a word are compared, and bounds tell which may be similar:
   lengths, the words that can still follow (position), and a 128-bit parity sketch, from whose
   differing bits follow differing words. None of them is ever wrong about a pair.
2. Classes that may be similar, directly or through others, make up groups. Only these go on, with
   their whole sets, to verification. A group is cut into blocks by hash, and each pair of blocks is
   one unit of work. A unit gives each of its classes its number of links and whether one of them
   is earlier: one row a class, never one a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, graph, shared, text

#: Words are counted in so many hash buckets; they fix the order of words in the prefixes.
COUNT_BITS = 16
#: Postings are sorted by one long: a word's hash above, the line's size (clipped) in so many bits below.
SIZE_BITS = 20
LARGEST = (1 << SIZE_BITS) - 1
_BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Similar:
    percent: int = 80  # Jaccard similarity of word sets
    block: int = 512  # classes in a block of a verified group
    crowd: int = 20_000  # postings of a word beyond which all its classes are verified


@dataclass
class Lines:
    """The lines with words of some texts. `words` holds their distinct words, line after line."""

    doc: np.ndarray  # of each line, the place of its text
    number: np.ndarray  # of each line within its text, from 0
    size: np.ndarray  # distinct words of each line
    words: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return (np.cumsum(self.size) - self.size).astype(np.int64)

    @property
    def line(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def keys(self) -> np.ndarray:
        """A hash of each line's set."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        total = np.add.reduceat(text.mix(self.words ^ np.uint64(0x5851F42D4C957F2D)), self.first)
        return text.mix(total + self.size.astype(np.uint64)).view(np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Two words of 64 bits for each line: whether an odd number of its words fall on each bit."""
        place = self.words >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        halves = [np.where(place < 64, bit, np.uint64(0)), np.where(place < 64, np.uint64(0), bit)]
        return tuple(np.bitwise_xor.reduceat(h, self.first).view(np.int64) if len(self.size) else np.zeros(0, np.int64) for h in halves)

    def by_rarity(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each line from rare to frequent, and their places in it.

        `counts` are the buckets' ranks by count; words of one bucket are ordered by further bits.
        """
        rank = counts[bucket_of(self.words)].astype(np.uint64)
        within = (self.words >> np.uint64(COUNT_BITS)) & np.uint64((1 << 44 - COUNT_BITS) - 1)
        order = by_line(self.line, (rank << np.uint64(44 - COUNT_BITS)) | within)
        return self.words[order], np.arange(len(self.words)) - np.repeat(self.first, self.size)


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def by_line(line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by line, then by the last 44 bits of a key. `line` ascends; up to 2**20 lines are sorted as one long."""
    if len(line) and line[-1] >> 20:
        return np.lexsort((key & np.uint64((1 << 44) - 1), line))
    return np.argsort((line.astype(np.uint64) << np.uint64(44)) | (key & np.uint64((1 << 44) - 1)))


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def lines_of(texts: list[str | None]) -> Lines:
    """The lines of some texts, letters A to Z in lower case; lines without words are left out."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(data)
    words, starts = text.words_and_starts(joined)
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    lengths = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    doc_start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(data) else np.zeros(0, np.int64)
    order = by_line(line, words)
    words, line = words[order], line[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line = words[new], line[new]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    own = line[first]
    begins = np.concatenate(([0], breaks + 1))[own]
    doc = np.searchsorted(doc_start, begins, "right") - 1
    number = own - np.searchsorted(breaks, doc_start)[doc] if len(own) else own
    return Lines(doc, number, np.diff(np.append(first, len(words))), words)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Slices of the batches of about a megabyte of text, with their lines; the column is `text`."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size < _BATCH_BYTES):
                size += len(texts[end] or "") + 1
                end += 1
            yield batch.slice(start, end - start), lines_of(texts[start:end])
            start = end


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each line (doc_id, line_no, key) and, with a null line_no, counts of word buckets (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch, lines in _texts(batches):
            counts += np.bincount(bucket_of(lines.words), minlength=len(counts))
            n = len(lines.size)
            yield {"doc_id": batch.column(0).take(pa.array(lines.doc)), "line_no": lines.number, "key": lines.keys(), "n": np.ones(n, np.int64)}
        some = np.flatnonzero(counts)
        yield {"doc_id": pa.nulls(len(some), id_type), "line_no": pa.nulls(len(some), pa.int32()), "key": some, "n": counts[some]}

    schema = arrow.schema(docs.schema["doc_id"], "line_no int, key long, n long")
    id_type = arrow.to_arrow_schema(schema).field("doc_id").type
    return arrow.map_batches(docs.select("doc_id", "text"), run, schema)


def _counts(scan: DataFrame) -> np.ndarray:
    """The rank of each word bucket by its count: 65,536 numbers, however large the input."""
    out = np.zeros(1 << COUNT_BITS, np.int64)
    buckets, sums = shared.fetched(scan.filter("line_no is null").groupBy("key").agg(F.sum("n").alias("n")))
    out[buckets] = sums
    ranks = np.empty(len(out), np.int64)
    ranks[np.argsort(out, kind="stable")] = np.arange(len(out))
    return ranks


def _postings(docs: DataFrame, counts: np.ndarray, similar: Similar) -> DataFrame:
    """(word, key, shape, odd0, odd1): the words of the prefix of each line, the clipped size in their lowest bits.

    shape is the line's full size and the word's place in it.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        seen: set[int] = set()  # spares most repeated lines; the rest go when postings meet
        for _, lines in _texts(batches):
            keys = lines.keys()
            fresh = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            if len(seen) > 500_000:
                seen.clear()
            words, place = lines.by_rarity(held.value)
            line, odd = lines.line, lines.parities()
            use = (place < prefix_length(lines.size, similar.percent)[line]) & fresh[line]
            line = line[use]
            shape = (lines.size[line] << 32) | place[use]
            packed = (words[use].view(np.int64) & ~LARGEST) | np.minimum(lines.size[line], LARGEST)
            yield {"word": packed, "key": keys[line], "shape": shape, "odd0": odd[0][line], "odd1": odd[1][line]}

    return arrow.map_batches(docs.select("text"), run, "word long, key long, shape long, odd0 long, odd1 long")


def _candidates(postings: DataFrame, similar: Similar) -> DataFrame:
    """(u, v): links that join all classes which no bound keeps apart into components.

    Postings are hashed by word, sorted by word and size, and read as a stream: rows of one word are
    compared with the next row, the one after that, and so on, for all words at once, until the sizes
    are too far apart. A word's rows that may be
    similar, directly or through others, are linked to one of them, so there is at most one link a
    posting. Of a word with very many postings all classes are linked without a comparison.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        names, held, crowded = ("word", "key", "shape", "odd0", "odd1"), None, False
        for batch in batches:
            now = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names}
            if held is not None:
                now = {n: np.concatenate((held[n], now[n])) for n in names}
            word, begin = now["word"] >> SIZE_BITS, 0
            if crowded:  # the word goes on: its rows are linked to its first one, which was held
                begin = int(np.searchsorted(word, word[0], "right"))
                yield {"u": now["key"][1:begin], "v": np.full(begin - 1, now["key"][0])}
                if begin == len(word):
                    held = {n: v[:1] for n, v in now.items()}
                    continue
            cut = int(np.searchsorted(word, word[-1]))  # the last word may go on
            crowded = len(word) - cut > similar.crowd
            if crowded:
                crowd = now["key"][cut:]
                yield {"u": crowd[1:], "v": np.full(len(crowd) - 1, crowd[0])}
            held = {n: v[cut : cut + 1] if crowded else v[cut:] for n, v in now.items()}
            yield _linked({n: v[begin:cut] for n, v in now.items()}, similar)
        if held is not None and not crowded:
            yield _linked(held, similar)

    spread = postings.repartition(F.shiftright("word", SIZE_BITS)).sortWithinPartitions("word")
    return arrow.map_batches(spread, run, "u long, v long").filter("u <> v").distinct()


def _linked(rows: dict[str, np.ndarray], similar: Similar) -> dict[str, np.ndarray]:
    """Links from rows, sorted by word and size, to the row that stands for all that they may be similar to."""
    word, key, p = rows["word"] >> SIZE_BITS, rows["key"], similar.percent
    size, place = rows["shape"] >> 32, rows["shape"] & 0xFFFFFFFF
    top = np.arange(len(word))  # of each row, a row before it that it is linked to
    at, step = np.arange(max(0, len(word) - 1)), 1
    while len(at):
        at = at[at + step < len(word)]
        other = at + step
        at = at[(word[at] == word[other]) & ((size[other] * p <= size[at] * 100) | (size[other] >= LARGEST))]  # below that, sizes only grow
        other = at + step
        sizes = size[at] + size[other]
        follow = np.minimum(size[at] - place[at], size[other] - place[other])
        able = at[(follow * (100 + p) >= sizes * p) & (key[at] != key[other])]
        differ = sum(np.bitwise_count((rows[n][able] ^ rows[n][able + step]).view(np.uint64)).astype(np.int64) for n in ("odd0", "odd1"))
        able = able[differ * (100 + p) <= (size[able] + size[able + step]) * (100 - p)]
        for i in able[top[able] != top[able + step]].tolist():
            a, b = i, i + step
            while top[a] != a:
                top[a] = top[top[a]]
                a = top[a]
            while top[b] != b:
                top[b] = top[top[b]]
                b = top[b]
            top[max(a, b)] = min(a, b)
        step += 1
    while not np.array_equal(top, top[top]):
        top = top[top]
    moved = np.flatnonzero(top != np.arange(len(top)))
    return {"u": key[moved], "v": key[top[moved]]}


def _sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(key, words): the sets of the classes in `active`."""
    held = docs.sparkSession.sparkContext.broadcast(shared.bitmap(active, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[dict]:
        for _, lines in _texts(batches):
            keys = lines.keys()
            _, chosen = np.unique(keys, return_index=True)
            chosen = chosen[shared.may_hold(held.value, keys[chosen].view(np.uint64))]
            if len(chosen):
                words, first = lines.words, lines.first
                yield {"key": keys[chosen], "words": [words[first[i] : first[i] + lines.size[i]].tobytes() for i in chosen]}

    rows = arrow.map_batches(docs.select("text"), run, "key long, words binary")
    return rows.join(active, "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))


def _links(sets: DataFrame, groups: DataFrame, classes: DataFrame, similar: Similar) -> DataFrame:
    """(key, n_links, earlier) of the classes in `sets`, each compared with those of its group (key, root).

    `classes` (key, first) has the order of lines. A group is cut into blocks by hash, and each pair
    of blocks is one unit of work; a set is sent once for each block of its group.
    """
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / similar.block).cast("int").alias("_blocks"))
    rows = sets.join(groups, "key").join(blocks, "root").join(classes, "key")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    units = rows.select(
        "root", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "key", "words",
        F.col("first.doc_id").alias("doc"), F.col("first.line_no").alias("line"),
    )
    units = units.repartition("root", "_i", "_j").sortWithinPartitions("root", "_i", "_j", "_own")

    def verify(rows: Iterator[dict]) -> Iterable[dict]:
        unit, held = None, []
        for row in rows:
            now = (row["root"], row["_i"], row["_j"])
            if now != unit and held:
                yield from _verified(held, unit[1] != unit[2], similar)
                held = []
            unit = now
            held.append(row)
        if held:
            yield from _verified(held, unit[1] != unit[2], similar)

    found = arrow.map_rows(units, verify, "key long, n_links long, earlier boolean", rows=4096)
    return found.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.max("earlier").alias("earlier"))


def _verified(rows: list[dict], between: bool, similar: Similar) -> Iterator[dict]:
    """Links within one block of classes or, if `between`, from each of two blocks to the other."""
    sets = [np.frombuffer(r["words"], np.int64) for r in rows]
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    flat, line = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[column]  # only words of two classes or more
    use = column >= 0
    has = np.zeros((len(sets), int((seen > 1).sum())), np.float32)
    has[line[use], column[use]] = 1
    common = (has @ has.T).astype(np.int64)
    linked = common * (100 + similar.percent) >= similar.percent * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if between:
        side = np.fromiter((r["_own"] for r in rows), np.int64, len(rows))
        linked &= side[:, None] != side[None, :]
    order = {key: n for n, key in enumerate(sorted({_order(r) for r in rows}))}
    at = np.fromiter((order[_order(r)] for r in rows), np.int64, len(rows))
    n_links, earlier = linked.sum(1), (linked & (at[None, :] < at[:, None])).any(1)
    for k in np.flatnonzero(n_links).tolist():
        yield {"key": rows[k]["key"], "n_links": int(n_links[k]), "earlier": bool(earlier[k])}


def _order(row: dict) -> tuple:
    return (row["doc"] is not None, row["doc"] or 0, row["line"])


def line_links(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """Class, links and fate of every line with words in `docs` (doc_id, text; others are ignored).

    Returns doc_id, line_no (from 0, between line feeds), class_doc_id and class_line_no (of the
    first line with the same set of words), n_links (other classes that are similar), removed.
    Lines are ordered by doc_id, null first, then by line_no. A line is removed if an earlier one
    has the same set or a similar one. Null and empty texts have no lines. Repeated rows repeat
    their lines: of lines that share doc_id, line_no and set, one counts as the first. An empty
    table gives an empty result.
    """
    scan = shared.staged(scanned(docs), "line-scan")
    lines = scan.filter("line_no is not null").select("doc_id", "line_no", "key")
    counts = _counts(scan)
    classes = shared.staged(lines.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "line-classes")
    found = graph.components(shared.staged(_candidates(_postings(docs, counts, similar), similar), "lines-candidates"))
    groups = shared.staged(found.withColumnRenamed("node", "key").union(found.select("root", "root").distinct()), "line-groups")
    sets = shared.staged(_sets(docs, groups.select("key")), "line-sets")
    links = shared.staged(_links(sets, groups, classes, similar), "line-links")
    facts = classes.join(links, "key", "left")
    counted = lines.groupBy("key", "doc_id", "line_no").agg(F.count(F.lit(1)).alias("_times"))
    counted = counted.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    rows = counted.join(facts, "key")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("_time") == 1)
    return rows.select(
        "doc_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (~is_first | F.coalesce("earlier", F.lit(False))).alias("removed"),
    )


def without_repeats(docs: DataFrame, similar: Similar = Similar()) -> DataFrame:
    """`docs` (doc_id, text and any others) without the lines that `line_links` removes, n_chars as it was.

    Rows that share a doc_id lose the lines that are removed from any of them. Null texts stay null;
    a text may become empty. Further columns are carried along, whatever their names. An empty table
    stays empty.
    """
    gone = line_links(docs, similar).filter("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    rows = shared.packed(docs).join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.array_join(F.filter(F.split("_row.text", "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept)
    return rows.withColumn("_row", F.col("_row").withField("text", text)).select("_row.*")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_links(shared.table(spark, sf_dir, "documents"))


def oracle(percent: int = 80) -> str:
    """DuckDB SQL for `line_links`: classes that share any word, compared in full."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, string_split({lower}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, list_sort(list_distinct(regexp_extract_all(unnest(ls), '{shared.WORD}'))) AS s FROM d
), n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, line_no) AS o FROM l WHERE len(s) > 0
), c AS (
  SELECT s, min(o) AS o, row_number() OVER () AS k FROM n GROUP BY s
), w AS (
  SELECT k, o, len(s) AS m, unnest(s) AS t FROM c
), f AS (
  SELECT t, count(*) AS df FROM w GROUP BY t
), r AS (
  SELECT w.*, row_number() OVER (PARTITION BY k ORDER BY df, t) AS place FROM w JOIN f USING (t)
), p AS (
  SELECT * FROM r WHERE place <= m - ceil(m * {percent} / 100.0) + 1
), g AS (
  SELECT DISTINCT a.k AS ka, b.k AS kb FROM p a JOIN p b ON a.t = b.t AND a.k <> b.k AND least(a.m, b.m) * 100 >= greatest(a.m, b.m) * {percent}
), e AS (
  SELECT ka, x.o AS oa, y.o AS ob FROM g JOIN c x ON x.k = ka JOIN c y ON y.k = kb
  WHERE len(list_intersect(x.s, y.s)) * (100 + {percent}) >= {percent} * (len(x.s) + len(y.s))
), s AS (
  SELECT ka, count(*) AS n_links, bool_or(ob < oa) AS earlier FROM e GROUP BY ka
)
SELECT n.doc_id, n.line_no::INTEGER AS line_no, h.doc_id AS class_doc_id, h.line_no::INTEGER AS class_line_no,
  coalesce(n_links, 0) AS n_links, n.o <> c.o OR coalesce(earlier, false) AS removed
FROM n JOIN c ON n.s = c.s JOIN n h ON h.o = c.o LEFT JOIN s ON s.ka = c.k"""
