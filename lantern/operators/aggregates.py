"""Counts and groups behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import verdict
from lantern.plans import taxonomy


def ccir_counts(items: DataFrame) -> DataFrame:
    """(ord, ccir, title, n, max_score) of every active requirement, those without items too."""
    counts = items.groupBy(F.upper(F.coalesce("ccir", F.lit("none"))).alias("ccir")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))
    dimension = taxonomy.dimension(items.sparkSession).select("ord", "ccir", "title")
    return F.broadcast(dimension).join(counts, "ccir", "right").filter("ord is not null").unionByName(
        dimension.join(counts, "ccir", "left_anti").withColumn("n", F.lit(0).cast("long")).withColumn("max_score", F.lit(None).cast("int"))
    )


def distribution(items: DataFrame, column: str) -> DataFrame:
    """(value, n, percent of the largest, half to even) of a tag, null as `none`, `none` left out of the percentages' base only if alone."""
    counts = items.groupBy(F.lower(F.coalesce(F.col(column), F.lit("none"))).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.bround(F.col("n") * 100 / F.max("n").over(Window.partitionBy())).cast("int"))


def hit_rate(items: DataFrame) -> DataFrame:
    """(total, kept, filtered, percent)."""
    kept = F.count_if(~verdict.is_none(F.col("ccir")))
    rows = items.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"))
    percent = F.when(F.col("total") > 0, F.bround(F.col("kept") * 100 / F.col("total"))).otherwise(0).cast("int")
    return rows.select("total", "kept", (F.col("total") - F.col("kept")).alias("filtered"), percent.alias("percent"))


def last_seen(items: DataFrame) -> DataFrame:
    """(source, last_seen); blank sources are dropped."""
    rows = items.withColumn("source", F.trim("source")).filter("source <> ''")
    return rows.groupBy("source").agg(F.max("ts").alias("last_seen"))


def source_status(registered: DataFrame, items: DataFrame, cutoff) -> DataFrame:
    """(source, last_seen, active): registered sources with what they last brought."""
    rows = registered.join(last_seen(items), "source", "left")
    return rows.withColumn("active", F.coalesce(F.col("last_seen") >= cutoff, F.lit(False)))


def top_per_group(items: DataFrame, group: str, n: int, order: list) -> DataFrame:
    """The first `n` rows of each group in a total order, numbered from 1 in `rank`."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def by_priority(items: DataFrame) -> list:
    """The order of reports: first tier, second, routine; then score, then item."""
    tier = F.when(F.col("cnr") == "I", 0).when(F.col("cnr") == "II", 1).otherwise(2)
    return [tier.asc(), F.coalesce(F.col("score"), F.lit(0)).desc(), F.col("item_id").asc()]


def cluster_summary(members: DataFrame) -> DataFrame:
    """(ccir, cluster, lead, sources, size, max_score, urgent) of clustered items.

    The lead has the highest score; of equal ones the least item.
    """
    best = F.max_by("item_id", F.struct(F.coalesce("score", F.lit(0)), -F.col("place")))
    return members.groupBy("ccir", "cluster").agg(
        best.alias("lead"), F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("size"),
        F.max(F.coalesce("score", F.lit(0))).alias("max_score"), F.bool_or(F.coalesce(F.col("cnr") == "I", F.lit(False))).alias("urgent"),
    )


def verdict_set(items: DataFrame) -> DataFrame:
    """(topics, n_keep, strict_topics) of a published brief."""
    topic = F.when(~verdict.is_none(F.col("ccir")), F.col("ccir"))
    return items.agg(
        F.array_sort(F.collect_set(topic)).alias("topics"), F.count_if(F.col("score") >= 8).alias("n_keep"),
        F.array_sort(F.collect_set(F.when(F.col("score") >= 8, topic))).alias("strict_topics"),
    )


def feed_counts(feeds: DataFrame) -> DataFrame:
    """(category, ok, transient, warn, bad) of probed feeds."""
    return feeds.groupBy("category").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "transient", "warn", "bad")])


def service_state(services: DataFrame) -> DataFrame:
    """One row: up if all services are, down if none is, else degraded."""
    up, n = F.count_if(F.col("status") == "up"), F.count(F.lit(1))
    return services.agg(F.when(up == n, "up").when(up == 0, "down").otherwise("degraded").alias("state"), up.alias("up"), n.alias("n"))


def changed_tags(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of `old` with their `new` tags and whether they changed; null equals null."""
    renamed = new.select(key, F.lit(True).alias("found"), *[F.col(c).alias(f"new_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return old.join(renamed, key, "left").withColumn("changed", ~same | F.col("found").isNull()).withColumn("found", F.coalesce("found", F.lit(False)))


def missing_languages(items: DataFrame, synthesis) -> DataFrame:
    """(missing): languages of the items that a text doesn't cite as `[id]` or `[id: title]`.

    `items` has item_id and lang, `synthesis` is a string column or literal over one row.
    """
    cited = F.transform(F.regexp_extract_all(synthesis, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda c: F.trim(F.element_at(F.split(c, ":"), 1)))
    known = items.filter(F.col("lang").isNotNull() & ~F.col("lang").isin("", "unknown"))
    found = F.collect_set(F.when(F.array_contains(cited, F.col("item_id")), F.col("lang")))
    return known.agg(F.array_sort(F.array_except(F.collect_set("lang"), found)).alias("missing"))


def within_budget(items: DataFrame, group: str, text, budget: int, n: int, order: list) -> DataFrame:
    """The first `n` rows of each group whose texts fit a budget of tokens together; the first always stays."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    used = F.sum(verdict.tokens(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter((F.col("used") <= budget) | (F.col("rank") == 1))


def tag_counts(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(value, n_old, n_new) of a tag before and after, null as `none`."""
    value = F.lower(F.coalesce(F.col(column), F.lit("none"))).alias("value")
    both = old.select(value, F.lit(1).alias("_old")).unionByName(new.select(value, F.lit(0).alias("_old")))
    return both.groupBy("value").agg(F.sum("_old").alias("n_old"), F.sum(1 - F.col("_old")).alias("n_new"))


#: Marks of a probed feed in the order in which reports list them: fixed values.
FEED_MARKS = {"warn": "⚠", "bad": "❌", "ok": "✅", "transient": "🟡"}


def feed_order() -> list:
    """Warnings first, then broken, working and transient feeds, each by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in FEED_MARKS]), F.col("status"))
    return [place.asc(), F.lower("title").asc(), F.col("title").asc(), F.col("url").asc()]


def feed_report(feeds: DataFrame) -> DataFrame:
    """(category, place, mark, title, url, status) of probed feeds, each category in report order."""
    mark = F.create_map(*[F.lit(x) for pair in FEED_MARKS.items() for x in pair])[F.col("status")]
    place = F.row_number().over(Window.partitionBy("category").orderBy(*feed_order()))
    return feeds.select("category", place.alias("place"), mark.alias("mark"), "title", "url", "status")


def with_clusters(items: DataFrame, members: DataFrame) -> DataFrame:
    """Add cluster, cluster_size and cluster_sources to items; without a cluster -1, 1 and the own source.

    `members` has item_id, ccir and cluster.
    """
    placed = members.select("item_id", "cluster").join(items.select("item_id", "ccir", "source"), "item_id")
    facts = placed.groupBy("ccir", "cluster").agg(F.count(F.lit(1)).cast("int").alias("cluster_size"), F.array_sort(F.collect_set("source")).alias("cluster_sources"))
    told = placed.select("item_id", "ccir", "cluster").join(facts, ["ccir", "cluster"]).drop("ccir")
    rows = items.join(told, "item_id", "left")
    own = F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("cluster", F.coalesce("cluster", F.lit(-1))).withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1))).withColumn("cluster_sources", F.coalesce("cluster_sources", own))


def regrouped(items: DataFrame) -> DataFrame:
    """(group, n, lead) of items with a cluster: by requirement and cluster, and each item alone whose cluster is -1."""
    number = F.when(F.col("cluster") < 0, F.concat(F.lit("-"), "item_id")).otherwise(F.col("cluster").cast("string"))
    group = F.concat(F.coalesce("ccir", F.lit("none")), F.lit("_"), number)
    lead = F.min_by("item_id", F.struct(-F.coalesce("score", F.lit(0)), "item_id"))
    return items.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), lead.alias("lead"))


def for_sections(items: DataFrame, sections: list[str], since) -> DataFrame:
    """Items of the window in the given sections, with `section` (upper case) and its place in the list: what clustering takes."""
    wanted = [s.upper() for s in sections]
    section = F.upper("ccir")
    rows = items.filter((F.col("created_at") >= since) & section.isin(*wanted))
    return rows.withColumn("section", section).withColumn("section_place", F.array_position(F.array(*[F.lit(s) for s in wanted]), section).cast("int"))


def clustered(items: DataFrame, threshold: float | None = None, by: Sequence[str] = ("ccir",)) -> DataFrame:
    """(ccir, cluster, place, item_id) of items: clusters that they bring along, else by vectors, else by key words.

    Columns decide: `cluster` is taken where there is one, then `embedding` is clustered with the
    threshold (0.75 if it is none between 0 and 1), then the titles' words. `by` names what a section is.
    """
    from lantern.functions import text
    from lantern.operators import folds

    if "cluster" in items.columns:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("score", F.lit(0)).desc(), "item_id")) - 1
        return items.select(*by, "cluster", place.alias("place"), "item_id")
    if "embedding" in items.columns:
        return folds.greedy_centroids(items, threshold if threshold is not None and 0 < threshold < 1 else 0.75, by)
    return folds.greedy_keywords(items.withColumn("words", text.keywords("title")), by=by)


def clustered_windows(items: DataFrame, sections: list[str], since, hours: int = 24, threshold: float | None = None) -> DataFrame:
    """(section, window, cluster, place, item_id): from stored items to clusters, for every window of so many hours from `since` on.

    Each section of each window is clustered for itself, as a run at the window's end would do it.
    """
    rows = for_sections(items, sections, since)
    window = F.floor((F.unix_seconds("created_at") - F.unix_seconds(since)) / (hours * 3600)).cast("long")
    return clustered(rows.withColumn("window", window), threshold, ["section", "window"])


def digest(items: DataFrame, sections: Column, first: int | None = None) -> DataFrame:
    """(section, rank, lead, size, sources, max_score, urgent): clusters of items, by vectors or key words, in the order of a report.

    `sections` is an array that names the sections of an item (none: it is left out), each clustered for
    itself. Within a section clusters go by their highest score, then as they were founded. `first`
    bounds the clusters of a section.
    """
    rows = items.withColumn("section", F.explode(sections))
    members = clustered(rows, by=("section",)).join(rows.select("section", "item_id", "score", "source", "cnr"), ["section", "item_id"])
    told = cluster_summary(members.withColumnRenamed("section", "ccir")).withColumnRenamed("ccir", "section")
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.col("max_score").desc(), "cluster")))
    return (told.filter(F.col("rank") <= first) if first is not None else told).drop("cluster")
