"""Near-duplicate documents by HyperMinHash sketches, banding and verification on full shingle sets.

1. Every text becomes its set of word shingles. Texts with equal sets form a class; all later work
   is on one representative a class, so exact copies cost one row each.
2. A sketch has 256 buckets, chosen by the leading byte of the shingle hash. Each keeps its least
   hash as a register of 16 bits: 6 for the number of leading zeros, 10 of mantissa. An empty
   bucket takes over the register of a full one, by a fixed random preference, so that two sets
   agree in any register with a probability of their Jaccard similarity.
3. Six registers make a band key; representatives that share a key are candidates. In a shared key
   each one is first paired with two hubs only: the member that shares most keys with others, which
   is a group's original more often than not, and one that differs from band to band.
4. Pairs are dropped where the Jaccard estimate from all registers, corrected for chance collisions
   of the compressed registers, lies six standard deviations below the threshold; the others are
   verified on their full sets.
5. First the best hub of each representative is tried, then the hubs in other components, and then
   what still shares a key across components. Copies that a hub has linked already are never paired
   with one another, and at the end each candidate pair across components has been tested or is
   ruled out by an exact bound of prefix, length or position on its shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, graph, shared, text

BUCKETS = 256
MANTISSA_BITS = 10
BAND_ROWS = 6
BANDS = BUCKETS // BAND_ROWS
RARITY_BITS = 18
#: Ids that are broadcast at most.
IN_MEMORY = 1_000_000
#: Chance that two unlike registers agree, by the analysis of the sketch: 0.1699 * 2 ** -bits.
COLLISION = 0.1699 * 2.0**-MANTISSA_BITS

_preference: list[np.ndarray] = []


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; documents are linked from `percent` Jaccard similarity on."""

    words: int = 5
    percent: int = 80


def registers(grams: np.ndarray) -> np.ndarray:
    """The 256 registers of a sorted, non-empty set of shingle hashes."""
    firsts = np.searchsorted(grams, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56))
    full = np.flatnonzero(np.diff(np.append(firsts, len(grams))))
    least = grams[firsts[full]] & np.uint64((1 << 56) - 1)
    mantissa, exponent = np.frexp(least.astype(np.float64))
    packed = ((56 - exponent).astype(np.int64) << MANTISSA_BITS) | np.floor((np.maximum(mantissa, 0.5) * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = packed.astype(np.uint16)
    if len(full) < BUCKETS:
        if not _preference:
            cells = np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS)
            _preference.append((text.mix(cells + np.uint64(1)) >> np.uint64(32)).astype(np.uint32))
        empty = np.setdiff1d(np.arange(BUCKETS), full, assume_unique=True)
        giver = full[np.argmin(_preference[0][np.ix_(empty, full)], axis=1)]
        # The taker's place goes into the register, so that a borrowed value is not an own one.
        out[empty] = out[giver] ^ text.mix(giver.astype(np.uint64)).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(BAND_ROWS):
        total = text.mix(total ^ rows[:, i])
    return total.view(np.int64)


def _class_key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketched(docs: DataFrame, likeness: Likeness) -> DataFrame:
    """(doc_id, n_shingles, key, sketch); key and sketch are null for a document without words."""

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            grams = text.shingle_set(row["text"], likeness.words)
            full = len(grams) > 0
            yield {
                "doc_id": row["doc_id"],
                "n_shingles": len(grams),
                "key": _class_key(grams) if full else None,
                "sketch": registers(grams).tobytes() if full else None,
            }

    return arrow.map_rows(docs.select("doc_id", "text"), run, arrow.schema(docs.schema["doc_id"], "n_shingles long, key long, sketch binary"))


def _bands(classes: DataFrame) -> DataFrame:
    """(key, band): a row for each band key of each class."""

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            keys = band_keys(np.frombuffer(row["sketch"], np.uint16))
            for band in keys.tolist():
                yield {"key": row["key"], "band": band}

    return arrow.map_rows(classes.select("key", "sketch"), run, "key long, band long", rows=16_384)


def _estimated(pairs: DataFrame, classes: DataFrame, likeness: Likeness) -> DataFrame:
    """(u, v, agree) of the pairs whose estimate does not rule them out."""
    least = likeness.percent / 100.0
    side = lambda name: classes.select(F.col("key").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    # Sizes alone bound the similarity.
    joined = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * likeness.percent)

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            same = int((np.frombuffer(row["su"], np.uint16) == np.frombuffer(row["sv"], np.uint16)).sum())
            estimate = (same / BUCKETS - COLLISION) / (1 - COLLISION)
            samples = min(BUCKETS, row["nu"], row["nv"])
            if estimate >= least - 6 * (least * (1 - least) / samples) ** 0.5:
                yield {"u": row["u"], "v": row["v"], "agree": same}

    return arrow.map_rows(joined, run, "u long, v long, agree int", rows=8192)


def _verified(pairs: DataFrame, sets: DataFrame, likeness: Likeness) -> DataFrame:
    """(u, v) of the pairs that reach the threshold on their full sets."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("grams").alias(f"g{name}"))
    joined = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            a, b = np.frombuffer(row["gu"], np.uint64), np.frombuffer(row["gv"], np.uint64)
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= likeness.percent * (len(a) + len(b) - common):
                yield {"u": row["u"], "v": row["v"]}

    return arrow.map_rows(joined, run, "u long, v long", rows=8192)


def _needed_sets(docs: DataFrame, needed: DataFrame, likeness: Likeness) -> DataFrame:
    """(key, grams) of the classes in `needed` (doc_id, staged), from their representatives' texts.

    Texts aren't shuffled: up to IN_MEMORY ids are broadcast; beyond that a bitmap of bounded size
    picks the rows, and the sets of what it lets through in excess go in a join on the id.
    """
    wanted = needed.select(F.col("doc_id").alias("_id")).distinct()
    few = needed.count() <= IN_MEMORY
    bits = docs.sparkSession.sparkContext.broadcast(None if few else shared.bitmap(wanted.select(F.xxhash64("_id").alias("h")), "h"))

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            if few or shared.may_hold(bits.value, np.array([row["h"]], np.int64).view(np.uint64))[0]:
                grams = text.shingle_set(row["text"], likeness.words)
                if len(grams):
                    yield {"doc_id": row["doc_id"], "key": _class_key(grams), "grams": grams.tobytes()}

    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    rows = rows.join(F.broadcast(wanted), same, "left_semi") if few else rows
    sets = arrow.map_rows(rows, run, arrow.schema(docs.schema["doc_id"], "key long, grams binary"), rows=256)
    return (sets if few else sets.join(wanted, same, "left_semi")).select("key", "grams")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of `found` (node, root)."""
    root = lambda name: found.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    joined = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return joined.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).drop("ru", "rv")


def _stars(ranked: DataFrame, ranks: list[Column]) -> DataFrame:
    """(u, v): each member of a key with the members that the `ranks` put first."""
    firsts = ranked.groupBy("band").agg(*[F.min(rank).alias(f"_{i}") for i, rank in enumerate(ranks)])
    hubs = firsts.select("band", F.array_distinct(F.array(*[F.col(f"_{i}.key") for i in range(len(ranks))])).alias("_hubs"))
    pairs = ranked.join(hubs, "band").select("key", F.explode("_hubs").alias("hub")).filter("key <> hub")
    return pairs.select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v")).distinct()


def _rarity(sets: DataFrame) -> np.ndarray:
    """The rank by count of each hash bucket of shingles: 262,144 numbers, however large the input."""

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for row in rows:
            np.add.at(counts, _rarity_bucket(np.frombuffer(row["grams"], np.uint64)), 1)
        for bucket in np.flatnonzero(counts).tolist():
            yield {"bucket": bucket, "n": int(counts[bucket])}

    total = np.zeros(1 << RARITY_BITS, np.int64)
    counts = arrow.map_rows(sets.select("grams"), run, "bucket int, n long", rows=16_384)
    buckets, sums = shared.fetched(counts.groupBy("bucket").agg(F.sum("n").alias("n")))
    total[buckets] = sums
    ranks = np.empty(len(total), np.int64)
    ranks[np.argsort(total, kind="stable")] = np.arange(len(total))
    return ranks


def _rarity_bucket(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64((1 << RARITY_BITS) - 1)).astype(np.int64)


def _prefixes(sets: DataFrame, likeness: Likeness) -> DataFrame:
    """(gram, key, root, n, place): the shingles that lead each of `sets` (key, root, grams) from rare to frequent.

    Two sets that reach the threshold share a shingle there, whatever the order, as long as it is
    one for all; counts by hash buckets make it a good one.
    """
    held = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            grams = np.frombuffer(row["grams"], np.uint64)
            n = len(grams)
            order = np.lexsort((grams, held.value[_rarity_bucket(grams)]))[: n - (likeness.percent * n + 99) // 100 + 1]
            for place, gram in enumerate(grams[order].view(np.int64).tolist()):
                yield {"gram": gram, "key": row["key"], "root": row["root"], "n": n, "place": place}

    return arrow.map_rows(sets.select("key", "root", "grams"), run, "gram long, key long, root long, n int, place int", rows=8192)


def _leftover(met: DataFrame, found: DataFrame, sets: DataFrame, likeness: Likeness) -> DataFrame:
    """(u, v): pairs across components, among the classes that share a key across components, that no exact bound rules out.

    They are joined on the shingles of their prefixes. Sizes, and the numbers of shingles that can
    still be common from there on, are part of the join's condition; under a shingle the members of
    its largest component are never paired with one another.
    """
    named = met.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "band", F.coalesce("root", "key").alias("root"))
    mixed = named.groupBy("band").agg((F.min("root") != F.max("root")).alias("_mixed")).filter("_mixed").select("band")
    named = named.join(mixed, "band", "left_semi").select("key", "root").distinct()
    posted = shared.staged(_prefixes(shared.staged(sets.join(named, "key"), "neardup-mixed"), likeness), "neardup-posted")
    groups = posted.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("_m"))
    groups = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("_c"), F.max(F.struct("_m", "root")).alias("_g")).filter("_c > 1").select("gram", F.col("_g.root").alias("giant"))
    posted = shared.staged(posted.join(groups, "gram"), "neardup-posted")
    rest = posted.filter("root <> giant").select(F.col("gram").alias("a_gram"), *[F.col(c).alias(f"a_{c}") for c in ("key", "root", "n", "place")])
    every = posted.select("gram", "giant", *[F.col(c).alias(f"b_{c}") for c in ("key", "root", "n", "place")])
    p, sizes = likeness.percent, F.col("a_n") + F.col("b_n")
    follow = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    able = (follow * (100 + p) >= sizes * p) & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * p)
    apart = (F.col("a_root") < F.col("b_root")) | ((F.col("b_root") == F.col("giant")) & (F.col("a_root") > F.col("b_root")))
    pairs = rest.join(every, (F.col("a_gram") == F.col("gram")) & apart & able)
    return pairs.select(F.least("a_key", "b_key").alias("u"), F.greatest("a_key", "b_key").alias("v")).distinct()


def class_components(docs: DataFrame, rows: DataFrame, likeness: Likeness) -> DataFrame:
    """(node, root) over the class keys of `rows`, as `sketched` gives them, staged."""
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = shared.staged(classes, "neardup-classes")
    bands = shared.staged(_bands(classes), "neardup-bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = shared.staged(bands.join(sizes, "band"), "neardup-met")  # members of keys that are shared
    central = met.groupBy("key").agg(F.sum("_n").alias("_c"))
    ranked = met.join(central, "key")
    hubs = _stars(ranked, [F.struct(-F.col("_c"), "key"), F.struct(F.xxhash64("band", "key"), "key")])
    likely = shared.staged(_estimated(hubs, classes, likeness), "neardup-likely")

    member = met.select("key").distinct()
    sets = shared.staged(_needed_sets(docs, shared.staged(classes.join(member, "key", "left_semi").select("doc_id"), "neardup-needed"), likeness), "neardup-sets")

    # Each class with the likeliest hub; a pair is tried if either end likes it best.
    ends = likely.select(F.col("u").alias("key"), F.struct("agree", "u", "v").alias("_p")).union(likely.select(F.col("v").alias("key"), F.struct("agree", "u", "v").alias("_p")))
    best = ends.groupBy("key").agg(F.max("_p").alias("_p")).select("_p.u", "_p.v").distinct()
    found = graph.components(shared.staged(_verified(best, sets, likeness), "neardup-links"))
    found = graph.extended(found, shared.staged(_verified(_across(likely, found), sets, likeness), "neardup-links"))

    cross = _leftover(met.select("key", "band"), found, sets, likeness).join(likely.select("u", "v"), ["u", "v"], "left_anti")
    last = shared.staged(_verified(_estimated(cross, classes, likeness), sets, likeness), "neardup-links")
    return graph.extended(found, last)


def near_duplicates(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:
    """Component of every row of `docs` (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id (the least doc_id that links reach), kept. A text that
    is null or has no words has no shingles and is alone. Documents with null doc_id are linked like
    others, but don't name a component unless it has no other; repeated rows share a component. An
    empty table gives an empty result.
    """
    rows = shared.staged(sketched(docs, likeness), "neardup-rows")
    found = class_components(docs, rows, likeness)
    narrow = rows.select("doc_id", "n_shingles", "key")
    rooted = narrow.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = shared.staged(rooted.select("doc_id", "n_shingles", "root"), "neardup-rooted")
    names = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = shared.join_hot(rooted, names, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:
    """One row of `docs` (doc_id, text and any others) for each component, with all its columns.

    It has the least doc_id of its component; null comes last. Rows are told apart by doc_id and
    text, so a row never goes because another one shares its doc_id. Where copies share doc_id as
    well, one of them stays. Null and empty texts and those without words all stay. Further columns
    are carried along, whatever their names. An empty table stays empty.
    """
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    held = shared.staged(near_duplicates(docs.select(named.alias("doc_id"), "text"), likeness), "neardup-held")
    names = (F.col("doc_id.id").alias("_id"), F.col("doc_id.text_key").alias("_text_key"))
    rows = shared.packed(docs)
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_text_key"))
    gone = shared.staged(held.filter(~F.col("kept")).select(*names).distinct(), "neardup-gone")
    rest = rows.join(shared.small(gone, IN_MEMORY), same, "left_anti")
    again = held.filter(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = shared.staged(again.select(*names), "neardup-again")
    if not again.isEmpty():
        doubled = shared.small(again, IN_MEMORY)
        one_each = rest.join(doubled, same).dropDuplicates(["_id", "_text_key"]).select("_row")
        rest = rest.join(doubled, same, "left_anti").union(one_each)
    return rest.select("_row.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), Likeness(words=3, percent=85))


def oracle(words: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for `near_duplicates`: all pairs that share a shingle, and a recursive closure."""
    window = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{shared.WORD}') AS w FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: {window}) END) AS g FROM d
), g AS (
  SELECT r, unnest(g) AS t FROM s
), p AS (
  SELECT a.r AS u, b.r AS v, count(*) AS n FROM g a JOIN g b ON a.t = b.t AND a.r <> b.r GROUP BY ALL
), e AS (
  SELECT u, v FROM p JOIN s a ON a.r = u JOIN s b ON b.r = v WHERE 100 * n >= {percent} * (len(a.g) + len(b.g) - n)
), reach AS (
  SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u
), least AS (
  SELECT u, min(doc_id) AS m FROM reach JOIN s ON s.r = v GROUP BY u
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM s LEFT JOIN least ON least.u = s.r"""
