"""Writes as resolved reads: upserts, admissions and lookups over append-only tables.

Plain Parquet tables have no MERGE: every write appends, with `seq` for its order of arrival, and
these functions give the state that the writes add up to. Each needs one shuffle by its key, with
aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions import identity
from lantern.functions import text as T
from lantern.operators import neighbours


def latest(writes: DataFrame, key: list[str], seq: str = "seq", first: tuple[str, ...] = (), keep_known: tuple[str, ...] = ()) -> DataFrame:
    """Last write wins for each key.

    Columns in `first` keep their first value, those in `keep_known` their last one that isn't null.
    """
    rest = [c for c in writes.columns if c not in (*key, *first, *keep_known)]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("_last")
    kept = [F.min_by(c, seq).alias(c) for c in first]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_known]
    rows = writes.groupBy(*key).agg(last, *kept, *known)
    return rows.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest], *first, *keep_known)


def upserted_items(writes: DataFrame) -> DataFrame:
    """Items by content hash: last write wins, created_at stays, a blank body is null."""
    return latest(writes.withColumn("body", T.blank_to_null("body")), ["item_id"], first=("created_at",))


def upserted_entities(writes: DataFrame) -> DataFrame:
    """Entities by (name_norm, lang): a null or empty vector never replaces one that is known."""
    vector = F.when(F.size("embedding") > 0, F.col("embedding"))
    return latest(writes.withColumn("embedding", vector), ["name_norm", "lang"], keep_known=("embedding",))


def inserted_links(writes: DataFrame) -> DataFrame:
    """Links by (entity_id, item_id, mention): the first one stays."""
    return writes.groupBy("entity_id", "item_id", "mention").agg(F.min_by("lang", "seq").alias("lang"))


def inserted_item_links(writes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, link, lang): `inserted_links` for writes that bring the links of an item as one array, with the same result.

    `writes` has the keys, seq, lang and `links`, an array. Such writes meet by their item, whose few writes are
    looked through as one row: no link is shuffled with its item's id, and none is sorted among those of other items.
    """
    met = writes.groupBy(*keys).agg(F.collect_list(F.struct("seq", "lang", "links")).alias("_w"))
    each = F.flatten(F.transform("_w", lambda w: F.transform(w["links"], lambda link: F.struct(link.alias("link"), w["seq"].alias("seq"), w["lang"].alias("lang")))))
    sorted_ = met.select(*keys, F.sort_array(each).alias("_l"))
    first = F.filter("_l", lambda one, i: ~F.get(F.col("_l"), i - 1)["link"].eqNullSafe(one["link"]))
    return sorted_.select(*keys, F.explode(first).alias("_l")).select(*keys, "_l.link", "_l.lang")


def upserted_translations(writes: DataFrame) -> DataFrame:
    """Translations by (text_hash, target_lang), with the time of the last one."""
    return latest(writes, ["text_hash", "target_lang"])


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    """(hash, data, path) of each distinct content of `data`."""
    rows = blobs.select(F.sha2("data", 256).alias("hash"), "data").dropDuplicates(["hash"])
    return rows.withColumn("path", identity.blob_path(F.col("hash")))


def admitted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with a discipline, quarantined rest): the given discipline, or the source type's."""
    rows = items.withColumn("discipline", identity.discipline(F.col("discipline"), F.col("source_type")))
    known = F.col("discipline").isin(*identity.DISCIPLINES)
    return rows.filter(known), rows.filter(~F.coalesce(known, F.lit(False)))


def unknown_only(items: DataFrame, known: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that aren't in the state yet; only those are published."""
    return items.join(known.select(key), key, "left_anti")


def recent_items(items: DataFrame, source_types: list[str] | None = None, limit: int = 200) -> DataFrame:
    """The newest items, optionally of some types, in the total order (ts, item_id) descending."""
    rows = items.filter(F.col("source_type").isin(*source_types)) if source_types else items
    return rows.orderBy(F.col("ts").desc(), F.col("item_id").desc()).limit(limit)


def audit(rows: DataFrame, op: str, table: str, details: list[str]) -> DataFrame:
    """Audit rows for a write: (op, table_name, item_id, details as JSON)."""
    return rows.select(F.lit(op).alias("op"), F.lit(table).alias("table_name"), "item_id", F.to_json(F.struct(*details)).alias("details"))


def cached_translations(items: DataFrame, cache: DataFrame, target: str, column: str = "title") -> DataFrame:
    """Add `translation` from the cache; null where a translator has yet to be asked."""
    hits = cache.filter(F.col("target_lang") == target).select("text_hash", "translation")
    return items.withColumn("text_hash", identity.text_hash(F.col(column))).join(hits, "text_hash", "left")


def translated(items: DataFrame, cache: DataFrame, target: str, translate, column: str = "title") -> tuple[DataFrame, DataFrame]:
    """(items with `translation`, new rows for the cache): `translate`, a column function, is asked once for each unknown text.

    A null or blank text is its own translation and never asked for. The answers are staged, so that
    neither of the results asks again.
    """
    rows = cached_translations(items, cache, target, column)
    wordy = F.coalesce(F.col(column).rlike(r"\S"), F.lit(False))
    unknown = rows.filter(wordy & F.col("translation").isNull()).select("text_hash", column).dropDuplicates(["text_hash"])
    made = neighbours.checkpointed(unknown.select("text_hash", translate(F.col(column)).alias("_made")))
    out = rows.join(made, "text_hash", "left").withColumn("translation", F.coalesce("translation", "_made", F.when(~wordy, F.col(column)))).drop("_made")
    return out, made.select("text_hash", F.lit(target).alias("target_lang"), F.col("_made").alias("translation"))


def by_key(rows: DataFrame, **key) -> DataFrame:
    """The rows with the given values, such as an item by item_id or an entity by (name_norm, lang); none on a miss.

    Equalities on columns reach the scan as pushed filters.
    """
    for column, value in key.items():
        rows = rows.filter(F.col(column).isNull() if value is None else F.col(column) == value)
    return rows


def of_keys(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns agree with a row of `keys`: a batched fetch by id."""
    return rows.join(keys.select(*columns).distinct(), columns, "left_semi")


def language_sample(items: DataFrame, langs: list[str], since, n: int = 50) -> DataFrame:
    """The newest items of some languages, an absent summary as ''."""
    rows = items.filter(F.col("lang").isin(*langs) & (F.col("ts") > since)).withColumn("summary", F.coalesce("summary", F.lit("")))
    return rows.orderBy(F.col("ts").desc(), F.col("item_id").desc()).limit(n)


#: Columns of a verdict as renderers take it.
VERDICT = ("item_id", "source", "source_type", "title", "url", "ccir", "cnr", "pmesii", "tessoc", "score", "why")


def verdicts(enriched: DataFrame) -> DataFrame:
    """Enriched rows as verdicts, without what only the store needs."""
    return enriched.select(*VERDICT)


def as_structs(enriched: DataFrame) -> DataFrame:
    """(item, verdict): each row's item and verdict as structs of their own."""
    rest = [c for c in VERDICT if c not in ("source", "source_type", "title", "url")]
    return enriched.select(F.struct("item_id", "source", "source_type", "url", "title", "ts", "lang").alias("item"), F.struct(*rest).alias("verdict"))


def from_structs(pairs: DataFrame) -> DataFrame:
    """The rows that `as_structs` was made of."""
    return pairs.select("item.*", *[F.col("verdict")[c].alias(c) for c in ("ccir", "cnr", "pmesii", "tessoc", "score", "why")])


def mailbox_counts(items: DataFrame, prefix: str = "imap://") -> DataFrame:
    """(n, best): how many items came from a kind of mailbox, and the one with the highest score (of equal ones the least)."""
    rows = items.filter(F.col("source").startswith(prefix))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min_by("item_id", F.struct(-F.coalesce("score", F.lit(0)), "item_id")).alias("best"))
