"""The library's queries over the driver's tables: views, aggregates, vectors, entities, texts, alerts and bus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lantern.functions import identity, names, places, text, verdict
from lantern.operators import aggregates, alerts, bus, entities, folds, index, neighbours, resolution, store, vectors, views
from lantern.plans import derive, records, registry, sequential, taxonomy
from lantern.plans.registry import query
from lantern.sources import mappers

#: Start of the windowed queries, in seconds.
SINCE = derive.EPOCH + 100 * derive.STEP
SCORE_ORDER = lambda: [F.coalesce(F.col("score"), F.lit(0)).desc(), F.col("item_id").asc()]


def _epoch(column: str):
    return F.unix_seconds(F.col(column))


def _joined(column):
    return F.array_join(column, "|")


# --- Views over enriched items -------------------------------------------------------------------

_COP = "ccir IN ('PIR-3','FFIR-1','FFIR-2','FFIR-3','FFIR-4') AND lower(pmesii) IN ('political','military','infrastructure')"


@query(f""", c AS (
  SELECT e.ccir, e.item_id, e.score, e.title, v.item_id IS NOT NULL AS has_vector,
    count(*) OVER (PARTITION BY e.ccir) AS n_items, max(e.score) OVER (PARTITION BY e.ccir) AS max_score,
    row_number() OVER (PARTITION BY e.ccir ORDER BY e.score DESC, e.item_id) AS rank
  FROM enriched e LEFT JOIN item_embeddings v ON v.item_id = e.item_id
  WHERE {_COP} AND epoch(e.created_at) >= {SINCE})
SELECT ccir, item_id, score, title, has_vector, n_items, max_score, rank FROM c WHERE rank <= 3""")
def brief_rows(spark, sf):
    """Per requirement of the operational picture: count, best score and the three best items."""
    items = views.cop(derive.enriched(spark, sf).filter(_epoch("created_at") >= SINCE))
    totals = items.groupBy("ccir").agg(F.count(F.lit(1)).alias("n_items"), F.max("score").alias("max_score"))
    top = aggregates.top_per_group(items.select("ccir", "item_id", "score", "title"), "ccir", 3, SCORE_ORDER())
    vectors_of = derive.item_embeddings(spark, sf).select("item_id", F.lit(True).alias("has_vector"))
    return top.join(totals, "ccir").join(vectors_of, "item_id", "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))


@query("SELECT item_id, ccir, score FROM enriched WHERE ccir <> 'none'")
def kept_items(spark, sf):
    return views.kept(derive.enriched(spark, sf)).select("item_id", "ccir", "score")


@query(f"SELECT item_id, ccir, pmesii FROM enriched WHERE {_COP}")
def view_cop(spark, sf):
    return views.view(derive.enriched(spark, sf), "cop").select("item_id", "ccir", "pmesii")


@query("SELECT item_id, ccir, pmesii, tessoc FROM enriched WHERE lower(coalesce(tessoc, '')) NOT IN ('', 'none') AND ccir LIKE 'PIR-%' AND lower(pmesii) IN ('information','military','economic')")
def view_cip(spark, sf):
    return views.view(derive.enriched(spark, sf), "cip").select("item_id", "ccir", "pmesii", "tessoc")


@query("SELECT item_id, ccir, pmesii, score FROM enriched WHERE ccir IN ('PIR-1','FFIR-2') AND lower(pmesii) IN ('military','economic') AND score >= 3")
def view_crp(spark, sf):
    params = {"ccir": "pir-1, FFIR-2", "pmesii": "military,Economic", "min_score": "3"}
    return views.view(derive.enriched(spark, sf), "crp", params).select("item_id", "ccir", "pmesii", "score")


def _linked_pages(spark, sf):
    """Pages whose summary names their URL twice, as the pages themselves hold none."""
    body = F.concat(F.lit("see ("), F.coalesce("url", F.lit("")), F.lit("), also "), F.coalesce("url", F.lit("")), F.lit("."))
    return derive.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("item_id"), "url", body.alias("summary"), (F.col("page_id") % 11).cast("int").alias("score"))


@query(r"SELECT page_id::VARCHAR AS item_id, url FROM pages WHERE regexp_matches(url, 'https?://[^\s<>]+') AND page_id % 11 >= 4")
def view_links(spark, sf):
    return views.links(_linked_pages(spark, sf), {"min_score": "4"}, ("summary",)).select("item_id", "url")


@query("SELECT item_id, score, row_number() OVER (PARTITION BY ccir ORDER BY score DESC, item_id) AS place, ccir FROM enriched WHERE score >= 8")
def strict_list(spark, sf):
    rows = views.strict(derive.enriched(spark, sf)).select("item_id", "score", "ccir")
    return aggregates.top_per_group(rows, "ccir", 2**31 - 1, SCORE_ORDER()).withColumnRenamed("rank", "place")


@query("SELECT item_id FROM enriched WHERE score >= 8 OR ccir <> 'none'")
def vault_items(spark, sf):
    return views.vault_keep(derive.enriched(spark, sf), without_mail=True).select("item_id")


@query("SELECT item_id, lang FROM articles WHERE lang NOT IN ('en','no','und') AND trim(title) <> ''")
def translation_gate(spark, sf):
    return views.needs_translation(derive.articles(spark, sf)).select("item_id", "lang")


@query("SELECT item_id, score, rank FROM (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM enriched WHERE ccir = 'none' AND cnr IN ('none','')) WHERE rank <= 10")
def routine_top10(spark, sf):
    rows = views.routine(derive.enriched(spark, sf)).select("item_id", "score").orderBy(*SCORE_ORDER()).limit(10)
    return aggregates.top_per_group(rows.withColumn("_all", F.lit(0)), "_all", 10, SCORE_ORDER()).drop("_all")


# --- Aggregates and ranking ----------------------------------------------------------------------


@query(f", n AS (SELECT unnest({list(taxonomy.ACTIVE_IDS)}) AS ccir, unnest(range({len(taxonomy.ACTIVE_IDS)})) AS ord) SELECT ord::INTEGER AS ord, ccir, count(item_id) AS n, max(score) AS max_score FROM n LEFT JOIN enriched USING (ccir) GROUP BY ALL")
def ccir_counts(spark, sf):
    return aggregates.ccir_counts(derive.enriched(spark, sf)).select("ord", "ccir", "n", "max_score")


_DIST = "SELECT lower(coalesce({0}, 'none')) AS value, count(*) AS n, round_even(count(*) * 100 / max(count(*)) OVER (), 0)::INTEGER AS percent FROM enriched GROUP BY 1"


@query(_DIST.format("pmesii"))
def pmesii_distribution(spark, sf):
    return aggregates.distribution(derive.enriched(spark, sf), "pmesii")


@query(_DIST.format("tessoc"))
def tessoc_distribution(spark, sf):
    return aggregates.distribution(derive.enriched(spark, sf), "tessoc")


@query("SELECT count(*) AS total, count(*) FILTER (ccir <> 'none') AS kept, count(*) FILTER (ccir = 'none') AS filtered, round_even(100 * count(*) FILTER (ccir <> 'none') / count(*), 0)::INTEGER AS percent FROM enriched")
def hit_rate(spark, sf):
    return aggregates.hit_rate(derive.enriched(spark, sf))


@query("SELECT source, epoch(max(ts))::BIGINT AS last_seen FROM articles WHERE trim(source) <> '' GROUP BY source")
def source_last_seen(spark, sf):
    return aggregates.last_seen(derive.articles(spark, sf)).select("source", _epoch("last_seen").alias("last_seen"))


@query(f""", r AS (SELECT DISTINCT source FROM articles UNION SELECT 'never seen'), l AS (SELECT source, epoch(max(ts))::BIGINT AS last_seen FROM articles WHERE score_ok GROUP BY source)
SELECT source, last_seen, coalesce(last_seen >= {SINCE}, false) AS active FROM r LEFT JOIN l USING (source)""".replace("WHERE score_ok ", "WHERE doc_id % 20 < 15 "))
def source_status(spark, sf):
    items = derive.articles(spark, sf)
    registered = items.select("source").distinct().union(spark.createDataFrame([("never seen",)], "source string"))
    rows = aggregates.source_status(registered, items.filter("doc_id % 20 < 15"), F.timestamp_seconds(F.lit(SINCE)))
    return rows.select("source", _epoch("last_seen").alias("last_seen"), "active")


@query("SELECT ccir, item_id, score, rank FROM (SELECT ccir, item_id, score, row_number() OVER (PARTITION BY ccir ORDER BY score DESC, item_id) AS rank FROM enriched) WHERE rank <= 10")
def top_per_ccir(spark, sf):
    return aggregates.top_per_group(derive.enriched(spark, sf).select("ccir", "item_id", "score"), "ccir", 10, SCORE_ORDER())


@query("SELECT ccir, item_id, cnr, score, row_number() OVER (PARTITION BY ccir ORDER BY CASE cnr WHEN 'I' THEN 0 WHEN 'II' THEN 1 ELSE 2 END, score DESC, item_id) AS rank FROM enriched")
def cnr_priority_order(spark, sf):
    items = derive.enriched(spark, sf).select("ccir", "item_id", "cnr", "score")
    return aggregates.top_per_group(items, "ccir", 2**31 - 1, aggregates.by_priority(items))


@query("SELECT list_aggregate(list_sort(list(DISTINCT ccir) FILTER (ccir <> 'none')), 'string_agg', '|') AS topics, count(*) FILTER (score >= 8) AS n_keep, list_aggregate(list_sort(list(DISTINCT ccir) FILTER (ccir <> 'none' AND score >= 8)), 'string_agg', '|') AS strict_topics FROM enriched")
def published_topics(spark, sf):
    rows = aggregates.verdict_set(derive.enriched(spark, sf))
    return rows.select(_joined("topics").alias("topics"), "n_keep", _joined("strict_topics").alias("strict_topics"))


@query(""", b AS (SELECT ccir, item_id, score, row_number() OVER w AS rank, sum(greatest(1, length(title) // 4)) OVER w AS used FROM enriched WHERE score >= 8 WINDOW w AS (PARTITION BY ccir ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING))
SELECT ccir, item_id, rank, used::BIGINT AS used FROM b WHERE rank <= 5 AND (used <= 60 OR rank = 1)""")
def bluf_inputs(spark, sf):
    items = views.strict(derive.enriched(spark, sf))
    return aggregates.within_budget(items, "ccir", F.col("title"), 60, 5, SCORE_ORDER()).select("ccir", "item_id", "rank", "used")


@query("SELECT ccir, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', '|') AS sources, count(*) AS size, max(score) AS max_score, bool_or(cnr = 'I') AS urgent, arg_min(item_id, (-score, item_id)) AS lead FROM enriched GROUP BY ccir")
def cluster_summaries(spark, sf):
    """The summary of clusters, each requirement taken for one."""
    from pyspark.sql import Window

    order = Window.partitionBy("ccir").orderBy("item_id")
    members = derive.enriched(spark, sf).withColumn("cluster", F.lit(0)).withColumn("place", F.row_number().over(order))
    rows = aggregates.cluster_summary(members)
    return rows.select("ccir", _joined("sources").alias("sources"), "size", "max_score", "urgent", "lead")


@query(""", n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Social' ELSE pmesii END AS new_pmesii, tessoc AS new_tessoc FROM enrichment WHERE doc_id % 10 <> 0)
SELECT e.doc_id, pmesii, new_pmesii, n.doc_id IS NOT NULL AS found, n.doc_id IS NULL OR pmesii IS DISTINCT FROM new_pmesii OR tessoc IS DISTINCT FROM new_tessoc AS changed FROM enrichment e LEFT JOIN n USING (doc_id)""")
def tag_regression_diff(spark, sf):
    old = derive.enrichment(spark, sf).select("doc_id", "pmesii", "tessoc")
    new = old.filter("doc_id % 10 <> 0").withColumn("pmesii", F.when(F.col("doc_id") % 9 == 0, "Social").otherwise(F.col("pmesii")))
    return aggregates.changed_tags(old, new, "doc_id", ["pmesii", "tessoc"]).select("doc_id", "pmesii", "new_pmesii", "found", "changed")


@query("SELECT quality, toxic, bucket, count(*) AS n FROM labels JOIN enrichment USING (doc_id) GROUP BY ALL")
def labels_by_bucket(spark, sf):
    rows = derive.table(spark, sf, "labels").join(derive.enrichment(spark, sf), "doc_id")
    return rows.groupBy("quality", "toxic", "bucket").agg(F.count(F.lit(1)).alias("n"))


_CITING = "Seen in [d1] and [d3: a title], not in (d2) or [none]."


@query(f""", i AS (SELECT 'd' || doc_id AS item_id, lang FROM articles), c AS (SELECT unnest(regexp_extract_all('{_CITING}', '\\[([^\\]]+)\\]', 1)) AS c)
SELECT list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', '|') AS missing FROM i WHERE lang NOT IN (SELECT lang FROM i JOIN c ON trim(split_part(c, ':', 1)) = item_id)""")
def language_coverage(spark, sf):
    items = derive.articles(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"), "lang")
    return aggregates.missing_languages(items, F.lit(_CITING)).select(_joined("missing").alias("missing"))


# --- Store ---------------------------------------------------------------------------------------


@query("SELECT item_id, source_type, title FROM articles WHERE source_type IN ('rss','yt') ORDER BY ts DESC, item_id DESC LIMIT 200")
def items_recent_by_type(spark, sf):
    return store.recent_items(derive.articles(spark, sf), ["rss", "yt"]).select("item_id", "source_type", "title")


@query("SELECT doc_id, item_id, sha256(coalesce(body, '')) AS text_hash, left(sha256(item_id || '|I'), 16) AS alert_id, md5(source || ':' || url) AS api_key, substr(item_id, 1, 2) || '/' || substr(item_id, 3, 2) || '/' || item_id AS blob_path FROM articles")
def item_identity(spark, sf):
    rows = derive.articles(spark, sf)
    return rows.select(
        "doc_id", "item_id", identity.text_hash(F.coalesce("body", F.lit(""))).alias("text_hash"), identity.alert_id(F.col("item_id"), F.lit("I")).alias("alert_id"),
        identity.api_key(F.col("source"), F.col("url")).alias("api_key"), identity.blob_path(F.col("item_id")).alias("blob_path"),
    )


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def item_dedup_exact(spark, sf):
    rows = derive.table(spark, sf, "documents").filter("text is not null").select(identity.text_hash(F.col("text")).alias("text_hash"), "doc_id")
    return rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def _writes(spark, sf):
    """Items written several times: a third as many keys as documents, some bodies blank."""
    rows = derive.articles(spark, sf)
    body = F.when(F.col("doc_id") % 4 == 0, " \t ").otherwise(F.col("title"))
    return rows.select((F.col("doc_id") / 3).cast("long").cast("string").alias("item_id"), F.col("doc_id").alias("seq"), "title", body.alias("body"), F.col("ts").alias("created_at"))


@query(f"SELECT (doc_id // 3)::VARCHAR AS item_id, max(doc_id) AS seq, arg_max(title, doc_id) AS title, CASE WHEN max(doc_id) % 4 <> 0 THEN arg_max(title, doc_id) END AS body, epoch(min(ts))::BIGINT AS created_at FROM articles GROUP BY 1")
def item_upsert_lww(spark, sf):
    rows = store.upserted_items(_writes(spark, sf).withColumn("_seq", F.col("seq")).withColumnRenamed("seq", "seq_out").withColumnRenamed("_seq", "seq"))
    return rows.select("item_id", F.col("seq_out").alias("seq"), "title", "body", _epoch("created_at").alias("created_at"))


@query("SELECT item_id FROM articles WHERE doc_id % 3 <> 0")
def new_items_anti(spark, sf):
    items = derive.articles(spark, sf).select("doc_id", "item_id")
    return store.unknown_only(items, items.filter("doc_id % 3 = 0")).select("item_id")


@query(""", s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'fax' ELSE source_type END AS source_type, CASE WHEN doc_id % 13 = 0 THEN 'GEOINT' END AS given FROM articles)
SELECT doc_id, coalesce(given, CASE source_type WHEN 'imap' THEN 'HUMINT' WHEN 'telegram' THEN 'SOCMINT' WHEN 'ais' THEN 'MASINT/AIS' WHEN 'fax' THEN NULL ELSE 'OSINT' END) AS discipline,
  given IS NULL AND source_type = 'fax' AS quarantined FROM s""")
def discipline_default(spark, sf):
    kind = F.when(F.col("doc_id") % 11 == 0, "fax").otherwise(F.col("source_type"))
    given = F.when(F.col("doc_id") % 13 == 0, "GEOINT")
    rows = derive.articles(spark, sf).select("doc_id", kind.alias("source_type"), given.alias("discipline"))
    good, bad = store.admitted(rows)
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True))).select("doc_id", "discipline", "quarantined")


@query("SELECT item_id, CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id % 10 END AS translation FROM articles")
def translation_cache_lookup(spark, sf):
    items = derive.articles(spark, sf).select("doc_id", "item_id", F.concat(F.lit("text "), (F.col("doc_id") % 10).cast("string")).alias("title"))
    writes = items.filter("doc_id % 2 = 0").select(identity.text_hash(F.col("title")).alias("text_hash"), F.lit("en").alias("target_lang"), F.concat(F.lit("T "), (F.col("doc_id") % 10).cast("string")).alias("translation"), F.col("doc_id").alias("seq"))
    return store.cached_translations(items, store.upserted_translations(writes), "en").select("item_id", "translation")


@query("SELECT 'put' AS op, 'articles' AS table_name, item_id, json_object('source_type', source_type, 'lang', lang)::VARCHAR AS details FROM articles")
def audit_rows(spark, sf):
    return store.audit(derive.articles(spark, sf), "put", "articles", ["source_type", "lang"])


# --- Vectors -------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"


@query(f""", s AS (SELECT item_id, ccir_id, {_COS.format("i.embedding", "c.embedding")} AS similarity FROM item_embeddings i, ccir_vectors c),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, ccir_id) AS n FROM s)
SELECT item_id, ccir_id, similarity, similarity >= 0.15 AS passes FROM r WHERE n = 1""")
def ccir_prefilter(spark, sf):
    rows = vectors.prefilter(derive.item_embeddings(spark, sf).select("item_id", "embedding"), derive.ccir_vectors(spark, sf), 0.15)
    return rows.select("item_id", "ccir_id", "similarity", "passes")


@query(f""", s AS (SELECT b.item_id, a.item_id AS duplicate_of, {_COS.format("a.embedding", "b.embedding")} AS similarity FROM item_embeddings b JOIN item_embeddings a
  ON a.created_at >= b.created_at - INTERVAL 7 DAY AND (a.created_at < b.created_at OR a.created_at = b.created_at AND a.item_id < b.item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, duplicate_of) AS n FROM s WHERE similarity >= {derive.TEST_SIMILARITY})
SELECT item_id, duplicate_of, similarity FROM r WHERE n = 1""")
def near_duplicate_window(spark, sf):
    return vectors.near_earlier(derive.item_embeddings(spark, sf), derive.TEST_SIMILARITY)


_RECALL = f"SELECT e.item_id, {_COS.format('v.embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS similarity FROM enriched e JOIN item_embeddings v USING (item_id) WHERE bucket <> 'skip' AND epoch(ts) >= {SINCE} ORDER BY similarity DESC, item_id LIMIT 50"


@query(_RECALL)
def recall_topk(spark, sf):
    asked = derive.table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding
    items = derive.enriched(spark, sf).join(derive.item_embeddings(spark, sf).select("item_id", "embedding"), "item_id")
    return vectors.recall(items, asked, since=F.timestamp_seconds(F.lit(SINCE))).select("item_id", "similarity")


@query(_RECALL)
def recall_indexed(spark, sf):
    """The same from a persisted index, of which only the cells are read that may hold an answer."""
    asked = derive.table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding
    items = derive.enriched(spark, sf).join(derive.item_embeddings(spark, sf).select("item_id", "embedding"), "item_id")
    path = f"{neighbours.shared_folder(spark)}/recall-{uuid.uuid4().hex}"
    index.build(items.select("item_id", "embedding", "bucket", "ccir", "ts"), path)
    return index.recall(spark, path, asked, since=F.timestamp_seconds(F.lit(SINCE))).select("item_id", "similarity")


@query(""", p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, place - 1 AS place, round(avg(v), 6) AS value FROM p GROUP BY ALL""")
def label_centroids(spark, sf):
    rows = vectors.centroids(derive.table(spark, sf, "embeddings"), ["label"])
    return rows.select("label", F.posexplode("centroid").alias("place", "value")).select("label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query(f""", p AS (SELECT c.ccir_id, {_COS.format("i.embedding", "c.embedding")} AS similarity, i.doc_id % 11 = (SELECT vec_id FROM embeddings e WHERE e.embedding = c.embedding) AS same FROM item_embeddings i, ccir_vectors c),
t AS (SELECT unnest(range(10, 41)) AS t)
SELECT t / 100 AS threshold, count(*) FILTER (same AND similarity * 100 >= t) / count(*) FILTER (same) AS collapse_rate, count(*) FILTER (NOT same AND similarity * 100 >= t) AS over_merges FROM p, t GROUP BY t""")
def threshold_sweep(spark, sf):
    """The sweep over pairs of items and requirements' vectors; pairs of one residue stand for the same entity."""
    every = derive.ccir_vectors(spark, sf).agg(F.collect_list(F.struct("ccir_id", F.col("embedding").alias("v"))).alias("all"))
    pairs = derive.item_embeddings(spark, sf).crossJoin(F.broadcast(every)).select("doc_id", "embedding", F.explode("all").alias("c"))
    place = F.array_position(F.array(*[F.lit(i) for i in taxonomy.ACTIVE_IDS]), F.col("c.ccir_id")) - 1
    scored = pairs.select(F.round(vectors.cosine(F.col("embedding"), F.col("c.v")), 6).alias("similarity"), (F.col("doc_id") % 11 == place).alias("same"))
    return vectors.similarity_sweep(scored, 10, 40)


# --- Entities ------------------------------------------------------------------------------------


@query("SELECT e.entity_id, e.name_norm, e.lang, coalesce(list_aggregate(list_sort(list(DISTINCT mention || ' (' || l.lang || ')') FILTER (mention IS NOT NULL)), 'string_agg', '|'), '') AS aliases, count(DISTINCT item_id) AS link_count FROM entities e LEFT JOIN entity_links l USING (entity_id) GROUP BY 1, 2, 3")
def entity_aliases(spark, sf):
    rows = entities.alias_counts(derive.item_mentions(spark, sf))
    return rows.select(derive.entity_id("name_norm", "lang").alias("entity_id"), "name_norm", "lang", _joined("aliases").alias("aliases"), "link_count")


@query(f"SELECT entity_id, e.name_norm, e.lang, epoch(min(ts))::BIGINT AS first_seen, epoch(max(ts))::BIGINT AS last_seen, count(DISTINCT item_id) AS items, list_aggregate(list_sort(list(DISTINCT ccir)), 'string_agg', '|') AS ccirs FROM entities e JOIN entity_links l USING (entity_id) JOIN enriched USING (item_id) WHERE epoch(ts) >= {SINCE} GROUP BY 1, 2, 3 ORDER BY items DESC, e.name_norm, e.lang LIMIT 500")
def entity_active(spark, sf):
    top = entities.most_active(entities.activity(derive.item_mentions(spark, sf), F.timestamp_seconds(F.lit(SINCE))))
    top = top.withColumn("entity_id", derive.entity_id("name_norm", "lang"))
    return top.select("entity_id", "name_norm", "lang", _epoch("first_seen").alias("first_seen"), _epoch("last_seen").alias("last_seen"), "items", _joined("ccirs").alias("ccirs"))


@query("SELECT item_id, string_agg(name || '/' || mention, '|' ORDER BY name, mention) AS entities FROM (SELECT DISTINCT item_id, name, mention, l.lang FROM entity_links l JOIN entities USING (entity_id)) GROUP BY item_id")
def entity_links_per_item(spark, sf):
    rows = entities.of_item_words(derive.item_words(spark, sf), entities.renamed(derive.item_mentions(spark, sf)))
    return rows.select("item_id", _joined(F.transform("entities", lambda e: F.concat(e["name"], F.lit("/"), e["mention"]))).alias("entities"))


_DRESSED = "CASE doc_id % 4 WHEN 0 THEN '  ' || upper(source) || '''s ' WHEN 1 THEN source || '.example.com' WHEN 2 THEN 'GitHub  Actions' ELSE 'Støre (' || source || ')' END"


def _dressed(spark, sf):
    """Names in several dresses: possessives, domains, platform chrome, punctuation."""
    place, source = F.col("doc_id") % 4, F.col("source")
    name = F.when(place == 0, F.concat(F.lit("  "), F.upper(source), F.lit("'s "))).when(place == 1, F.concat(source, F.lit(".example.com")))
    return derive.articles(spark, sf).select("doc_id", name.when(place == 2, "GitHub  Actions").otherwise(F.concat(F.lit("Støre ("), source, F.lit(")"))).alias("name"))


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^\p{L}\p{N}_\s''-]+', '', 'g'), '[''s]+$', ''), '\s+', ' ', 'g'))"


@query(f", d AS (SELECT doc_id, {_DRESSED} AS name FROM articles) SELECT doc_id, {_NORMAL} AS name_norm FROM d")
def normalize_names(spark, sf):
    return _dressed(spark, sf).select("doc_id", names.normalize_name(F.col("name")).alias("name_norm"))


@query(rf", d AS (SELECT doc_id, {_DRESSED} AS name FROM articles) SELECT doc_id, name FROM d WHERE NOT (regexp_matches(lower(trim(name)), '^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{{2,}}$') OR {_NORMAL} IN ('github', 'github action', 'black', 'medium'))")
def noise_entity_filter(spark, sf):
    return _dressed(spark, sf).filter(~names.is_noise(F.col("name"))).select("doc_id", "name")


# --- Text ----------------------------------------------------------------------------------------


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || ' View image: https://a.b/c TODAY''S HIGHLIGHTS end', '<[^>]+>', ' ', 'g'), 'https?://[^ \t\n\r\f\v]+', ' ', 'g'),
  'View image:|Follow image link:|View in browser|·Member|Today''s highlights|Please use an email client supporting HTML email', ' ', 'gi'), '[ \t\n\r\f\v]+', ' ', 'g')) AS clean FROM pages""")
def clean_for_embedding(spark, sf):
    dressed = F.concat("html", F.lit(" View image: https://a.b/c TODAY'S HIGHLIGHTS end"))
    return derive.table(spark, sf, "pages").select("page_id", text.clean_for_embedding(dressed).alias("clean"))


@query(r"""SELECT item_id, u AS raw, CASE WHEN contains(u, '(') THEN regexp_replace(u, '[.,;:!?]+$', '') ELSE regexp_replace(u, '[.,;:!?)]+$', '') END AS url FROM (
  SELECT page_id::VARCHAR AS item_id, unnest(regexp_extract_all('see (' || url || '), also ' || url || '.', 'https?://[^\s<>"'']+(?:\([^\s<>"'']*\)[^\s<>"'']*)*')) AS u FROM pages)""")
def extract_urls(spark, sf):
    rows = _linked_pages(spark, sf).select("item_id", F.explode(text.outbound_urls("summary")).alias("raw"))
    return rows.select("item_id", "raw", text.trim_url("raw").alias("url"))


@query(r"""SELECT page_id::VARCHAR AS item_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CASE WHEN contains(u, '(') THEN regexp_replace(u, '[.,;:!?]+$', '') ELSE regexp_replace(u, '[.,;:!?)]+$', '') END END AS url FROM (
  SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN [NULL] ELSE regexp_extract_all('see (' || url || '), also ' || url || '.', 'https?://[^\s<>"'']+(?:\([^\s<>"'']*\)[^\s<>"'']*)*') END) AS u FROM pages)""")
def links_report(spark, sf):
    """A row for each URL; items without one keep a row."""
    body = F.when(F.col("item_id").cast("long") % 3 == 0, "none here").otherwise(F.col("summary"))
    rows = _linked_pages(spark, sf).select("item_id", F.explode_outer(text.outbound_urls(body)).alias("url"))
    return rows.select("item_id", text.trim_url("url").alias("url"))


@query(rf"SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '{text.KEYWORD_PATTERN}')), lambda w: NOT list_contains({list(dict.fromkeys(text.STOPWORDS))}, w))) AS word FROM articles")
def keyword_tokens(spark, sf):
    return derive.articles(spark, sf).select("item_id", F.explode(text.keywords("title")).alias("word"))


@query(r"""SELECT item_id, right(coalesce(nullif(lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'untitled'), 32) AS tail_slug,
  left(lower(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}\p{M}_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 50) AS page_slug,
  replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM articles""")
def slugs(spark, sf):
    return derive.articles(spark, sf).select("item_id", text.tail_slug("title").alias("tail_slug"), text.page_slug("title").alias("page_slug"), text.escape_html("title").alias("escaped"))


@query(r"""SELECT doc_id, 'ukraina ' || doc_id AS latin, left(regexp_replace('oAE? ' || title, '[^\x00-\x7F]', '?', 'g'), 80) AS header,
  CASE WHEN doc_id % 3 = 0 THEN 'und' WHEN doc_id % 3 = 1 THEN 'no' ELSE 'en' END AS guessed FROM articles""")
def scripts(spark, sf):
    guess = F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 1, "blåbær").otherwise("plain")
    return derive.articles(spark, sf).select(
        "doc_id", text.latin_key(F.concat(F.lit("Украина "), F.col("doc_id").cast("string"))).alias("latin"),
        text.ascii_header(F.concat(F.lit("øÆЖ "), "title", F.lit("\nsecond"))).alias("header"), text.guess_language(guess).alias("guessed"),
    )


@query("""SELECT doc_id, CASE WHEN bad THEN 'none' ELSE ccir END AS ccir, CASE WHEN bad THEN 0 ELSE least(10, greatest(0, score * 2 - 3)) END AS score,
  CASE WHEN bad OR ccir = 'none' THEN 'none' ELSE coalesce(pmesii, 'none') END AS pmesii,
  CASE WHEN bad OR ccir = 'none' THEN 'skip' WHEN cnr = 'I' OR least(10, greatest(0, score * 2 - 3)) >= 7 THEN 'read' ELSE 'maybe' END AS bucket,
  CASE WHEN bad THEN 'uleselig modell-svar' ELSE why END AS why FROM (SELECT *, doc_id % 5 = 4 AS bad FROM enrichment)""")
def verdict_salvage(spark, sf):
    """Models' answers in several dresses, among them out-of-range scores and broken JSON, and what is read from them."""
    rows = derive.enrichment(spark, sf).withColumn("score", F.col("score") * 2 - 3)
    plain = F.to_json(F.struct("ccir", "cnr", "pmesii", "score", "why"))
    place = F.col("doc_id") % 5
    raw = F.when(place == 0, plain).when(place == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(place == 2, F.concat(F.lit("Sure: "), plain, F.lit(" Done."))).when(place == 3, F.concat(F.lit("\n "), plain)).otherwise(F.concat(plain, F.lit("}")))
    v = verdict.salvage(raw)
    return rows.select("doc_id", v.alias("v")).select("doc_id", "v.ccir", "v.score", "v.pmesii", "v.bucket", "v.why")


@query("SELECT doc_id, CASE WHEN score >= 8 THEN 'hot' WHEN score >= 6 THEN 'warm' ELSE 'cool' END AS class, least(100, score * 10) AS width, CASE WHEN cnr = 'none' THEN 'Routine' ELSE cnr END AS tier, CASE bucket WHEN 'read' THEN 'keep' ELSE bucket END AS state, greatest(1, length(why) // 4)::INTEGER AS tokens FROM enrichment")
def verdict_events(spark, sf):
    """The words and widths that events and pages use for a stored verdict."""
    rows = derive.enrichment(spark, sf)
    return rows.select(
        "doc_id", verdict.score_class(F.col("score")).alias("class"), verdict.bar_width(F.col("score")).alias("width"), verdict.event_cnr(F.col("cnr")).alias("tier"),
        verdict.event_bucket(F.col("bucket")).alias("state"), verdict.tokens(F.col("why")).alias("tokens"),
    )


@query(f"SELECT doc_id, epoch(timezone('Europe/Oslo', date_trunc('day', timezone('Europe/Oslo', timezone('UTC', ts))) - INTERVAL 8 HOUR))::BIGINT AS cutoff FROM articles")
def oslo_cutoffs(spark, sf):
    return derive.articles(spark, sf).select("doc_id", F.unix_seconds(places.yesterday_at_16(F.col("ts"))).alias("cutoff"))


@query(r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'bad' WHEN 1 THEN 'transient' WHEN 2 THEN 'warn' WHEN 3 THEN 'ok' WHEN 4 THEN 'ok' ELSE 'warn' END AS status FROM pages""")
def feed_probe_status(spark, sf):
    place = F.col("page_id") % 6
    status = F.element_at(F.array(*[F.lit(s) for s in ("err", "429", "301", "200", "200", "200")]), (place + 1).cast("int"))
    body = F.when(place == 3, "<?xml version='1.0'?><rss>").when(place == 4, "﻿ <feed xmlns='x'>").otherwise(F.concat(F.col("html"), F.lit("<rss>")))
    return derive.table(spark, sf, "pages").select("page_id", places.feed_status(status, body).alias("status"))


# --- Mappers -------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'telegram:' || conv_id || ':' || turn) AS title, 'https://t.me/' || conv_id || '/' || turn AS url, left(text, 500) AS summary, 'C3' AS reliability FROM conversations")
def chat_items(spark, sf):
    rows = derive.table(spark, sf, "conversations").withColumn("channel", F.concat(F.lit("@"), F.col("conv_id").cast("string")))
    items = mappers.chat_items(rows.withColumnRenamed("turn", "id").withColumn("date", F.timestamp_seconds(F.lit(derive.EPOCH))))
    keys = F.split(F.regexp_replace("url", "https://t.me/", ""), "/")
    plain = items.select(keys[0].cast("long").alias("conv_id"), keys[1].cast("long").alias("turn"), F.regexp_replace("title", "telegram:@", "telegram:").alias("title"), "url", "summary", F.col("admiralty_reliability").alias("reliability"))
    return plain


@query(r"""SELECT event_id, 'AIS: vessel-' || user_id || ' (' || user_id || ') near Unknown' AS title, 'urn:mmsi:' || user_id AS url,
  'MMSI: ' || user_id || '; Position: ' || printf('%.5f', (60 + event_id % 30)::DOUBLE) || ', ' || printf('%.5f', (5.5 + event_id % 40)::DOUBLE) AS summary,
  60 + event_id % 30 BETWEEN 74 AND 81 AND 5.5 + event_id % 40 BETWEEN 15 AND 35 AS inside FROM events""")
def vessel_items(spark, sf):
    rows = derive.table(spark, sf, "events")
    lat, lon = (F.lit(60) + F.col("event_id") % 30).cast("double"), F.lit(5.5) + F.col("event_id") % 40
    reports = rows.select("event_id", F.to_json(F.struct(F.col("user_id").alias("mmsi"), lat.alias("lat"), lon.alias("longitude"))).alias("report"), lat.alias("la"), lon.alias("lo"))
    items = mappers.vessel_items(reports)
    return items.select("event_id", "title", "url", "summary", places.in_area(F.col("la"), F.col("lo"), "74,15,81,35").alias("inside"))


# --- Alerts and messages -------------------------------------------------------------------------


@query("""SELECT a.seq, count(*) FILTER (b.fired_at > a.fired_at - 60000000) AS last_60s, count(*) AS last_600s FROM alert_attempts a JOIN alert_attempts b
  ON b.fired_at <= a.fired_at AND b.fired_at > a.fired_at - 600000000 GROUP BY a.seq""")
def alert_sliding_counts(spark, sf):
    return alerts.sliding_counts(derive.alert_attempts(spark, sf)).select("seq", "last_60s", "last_600s")


@query(""", g AS (SELECT *, coalesce(nullif(trim(split_part(coalesce(pmesii, ''), ',', 1)), ''), 'Unclassified') AS domain FROM alert_attempts WHERE seq % 3 = 0 AND seq % 7 <> 0)
SELECT domain, count(*) AS n, min(fired_at) AS first_at, string_agg(item_id, '|' ORDER BY fired_at, item_id) AS items FROM g GROUP BY domain""")
def alert_digest_groups(spark, sf):
    state = derive.alert_attempts(spark, sf).withColumn("suppressed", F.col("seq") % 3 == 0).withColumn("digested_at", F.when(F.col("seq") % 7 == 0, F.col("fired_at")))
    return alerts.digest_groups(state).withColumn("items", _joined("items"))


@query("SELECT seq, pmesii, row_number() OVER (ORDER BY pmesii ASC NULLS LAST, fired_at, seq) - 1 AS place FROM (SELECT * REPLACE (CASE WHEN seq % 5 <> 0 THEN pmesii END AS pmesii) FROM alert_attempts) WHERE seq % 3 = 0 AND seq % 7 <> 0")
def alert_digest_order(spark, sf):
    """The rows of a digest in their order; every fifth alert has no domain."""
    state = derive.alert_attempts(spark, sf).withColumn("pmesii", F.when(F.col("seq") % 5 != 0, F.col("pmesii")))
    state = state.withColumn("suppressed", F.col("seq") % 3 == 0).withColumn("digested_at", F.when(F.col("seq") % 7 == 0, F.col("fired_at")))
    return alerts.undigested(state).select("seq", "pmesii", "place")


@query("SELECT left(sha256(item_id || '|' || cnr), 16) AS alert_id, item_id, left(why, 500) AS excerpt, coalesce(pmesii, '') AS tags, 'obsidian://open?vault=obsidian&file=brief-outbox%2F' || item_id || '.md' AS note_link FROM enriched WHERE cnr = 'I'")
def alert_payloads(spark, sf):
    rows = alerts.payloads(alerts.urgent(derive.enriched(spark, sf)))
    return rows.select("alert_id", "item_id", "excerpt", _joined("pmesii_tags").alias("tags"), "note_link")


@query("SELECT seq, fired_at FROM (SELECT *, fired_at - lag(fired_at) OVER (PARTITION BY item_id ORDER BY fired_at, seq) AS gap FROM alert_claims) WHERE gap IS NULL")
def alert_first_claims(spark, sf):
    """The first alert of each item: what a time to live without end would fire."""
    claims = derive.alert_claims(spark, sf).withColumn("dedupe_id", identity.alert_id(F.col("item_id"), F.col("cnr_tier")))
    return folds.claim_alerts(claims, ttl=2**62).filter("fires").select("seq", "fired_at")


@query('SELECT routing_key, item_id, min("offset") AS "offset", arg_min(body, "offset") AS body FROM bus_messages GROUP BY 1, 2')
def bus_idempotent(spark, sf):
    return bus.published_once(derive.bus_messages(spark, sf))


@query("""SELECT "offset", CASE WHEN "offset" % 4 <> 3 THEN 'news' END AS origin_exchange, CASE WHEN "offset" % 4 <> 3 THEN routing_key END AS origin_key, "offset" % 5 <> 0 AS readable FROM bus_messages""")
def dlq_routes(spark, sf):
    rows = derive.bus_messages(spark, sf)
    death = F.to_json(F.array(F.struct(F.lit("news").alias("exchange"), F.array("routing_key").alias("routing-keys"))))
    letters = rows.withColumn("x_death", F.when(F.col("offset") % 4 != 3, death)).withColumn("body", F.when(F.col("offset") % 5 == 0, "not json").otherwise(F.lit("{}")))
    return bus.dead_letters(letters).select("offset", "origin_exchange", "origin_key", "readable")


@query("""SELECT "offset", unnest(CASE "offset" % 4 WHEN 0 THEN ['q.triage'] WHEN 1 THEN ['q.brief', 'q.wiki', 'q.alerting'] WHEN 2 THEN ['q.notify', 'q.alerting'] ELSE [] END) AS queue FROM bus_messages""")
def bus_fan_out(spark, sf):
    keys = F.array(*[F.lit(k) for k in ("item.ingested", "verdict.ready", "sab.published", "no.route")])
    rows = derive.bus_messages(spark, sf).withColumn("routing_key", F.element_at(keys, (F.col("offset") % 4 + 1).cast("int")))
    return bus.delivered(rows).select("offset", "queue")


# --- Rules that go from row to row; their twins are recursive queries -------------------------------

_KEPT = "FROM enriched {} WHERE ccir <> 'none'"


@query(sequential.centroid_clusters("SELECT ccir, item_id, score, embedding " + _KEPT.format("LEFT JOIN (SELECT item_id, embedding FROM item_embeddings) USING (item_id)"), derive.TEST_SIMILARITY))
def cluster_greedy_centroid(spark, sf):
    items = derive.enriched(spark, sf).join(derive.item_embeddings(spark, sf).select("item_id", "embedding"), "item_id", "left")
    return folds.greedy_centroids(views.kept(items), derive.TEST_SIMILARITY)


@query(sequential.keyword_clusters("SELECT ccir, item_id, score, title " + _KEPT.format("")))
def cluster_greedy_keyword(spark, sf):
    return folds.greedy_keywords(views.kept(derive.enriched(spark, sf)).withColumn("words", text.keywords("title")))


_RESOLVED = 0.97
_PARTS = ", ".join(f"('0x' || substr(sha256(name_norm || ':{i // 16}'), {i % 16 * 4 + 1}, 4))::INTEGER / 65535" for i in range(16))


@query(f""", named AS (
  SELECT *, ('0x' || left(entity_id, 15))::BIGINT AS seq, ('0x' || right(entity_id, 1))::INTEGER % 4 = 0 AS known, list_transform([{_PARTS}], lambda x: x::FLOAT::DOUBLE) AS v FROM entities
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY NOT known, CASE WHEN NOT known THEN seq END, entity_id) AS rank, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS unit FROM named
), near AS MATERIALIZED (
  SELECT a.rank AS later, b.rank AS earlier, round(list_inner_product(a.unit, b.unit), 9) AS similarity
  FROM ranked a JOIN ranked b ON b.rank < a.rank AND NOT a.known WHERE list_inner_product(a.unit, b.unit) >= {_RESOLVED - 1e-8} AND round(list_inner_product(a.unit, b.unit), 9) >= {_RESOLVED}
), rounds AS (
  SELECT rank, CASE WHEN known THEN 1 ELSE 0 END AS state FROM ranked
  UNION ALL
  SELECT s.rank, CASE WHEN s.state <> 0 THEN s.state WHEN coalesce(p.led, false) THEN 2 WHEN coalesce(p.open, false) THEN 0 ELSE 1 END
  FROM rounds s LEFT JOIN (SELECT later, bool_or(state = 1) AS led, bool_or(state = 0) AS open FROM near JOIN rounds r ON r.rank = earlier GROUP BY later) p ON p.later = s.rank
  WHERE EXISTS (SELECT 1 FROM rounds WHERE state = 0)
), leads AS (
  SELECT DISTINCT rank FROM rounds WHERE state = 1
), taken AS (
  SELECT later, arg_min(earlier, (-similarity, earlier)) AS target FROM near JOIN leads ON rank = earlier WHERE later NOT IN (FROM leads) GROUP BY later
)
SELECT a.name_norm, a.lang, coalesce(b.entity_id, a.entity_id) AS entity_id, b.rank IS NULL AS made
FROM ranked a LEFT JOIN taken ON later = a.rank LEFT JOIN ranked b ON b.rank = target WHERE NOT a.known""")
def entity_resolution_fold(spark, sf):
    """Names in the order of their ids; a quarter of them, by the last digit of the id, are known entities."""
    # Staged, since the texts would be read once for each use of the names.
    rows = neighbours.checkpointed(derive.entity_names(spark, sf).withColumn("embedding", vectors.hashed_vector(F.col("name_norm"), 16)))
    known = F.conv(F.right("entity_id", F.lit(1)), 16, 10).cast("int") % 4 == 0
    names_ = rows.filter(~known).withColumn("seq", F.conv(F.left("entity_id", F.lit(15)), 16, 10).cast("long"))
    return resolution.resolve_entities(names_, rows.filter(known), _RESOLVED)


@query(sequential.claims(86_400_000_000))
def alert_claim_fold(spark, sf):
    claims = derive.alert_claims(spark, sf).withColumn("dedupe_id", identity.alert_id(F.col("item_id"), F.col("cnr_tier")))
    return folds.claim_alerts(claims)


@query(sequential.throttled((("60s", 60_000_000, 5), ("600s", 600_000_000, 10))))
def alert_throttle_fold(spark, sf):
    return folds.throttle_alerts(derive.alert_attempts(spark, sf))


def queries() -> dict[str, registry.Query]:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()


#: Importing the modules registers their queries.
MODULES = (records,)
