"""Standing pages about entities, kept up to date by what a batch touches.

A page is a view over the items nearest to its subject. When items come in, only the subjects that they
are linked to may change by them, so only their pages are made anew (`touched`); a periodic run makes
those of the most active subjects. All pages of a run are one plan: sources by matrix products, one
prompt and one answer a page, the flag of languages left out, links to other subjects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators import neighbours, ordering, tiles
from lantern.sinks import notes

#: Items that a page rests on.
SOURCES = 20
# The query prefix of the embedding model, and how a page flags languages that it leaves out.
QUERY = "query: "
FLAG = "\n\n> ⚠️ **Verification Flag**: {} language sources were present but not cited."


def touched(links: DataFrame, batch: DataFrame) -> DataFrame:
    """(entity_id) of the entities that the items of a batch (item_id) are linked to."""
    return links.join(batch.select("item_id").distinct(), "item_id", "left_semi").select("entity_id").distinct()


def sources(subjects: DataFrame, items: DataFrame, k: int = SOURCES) -> DataFrame:
    """(entity_id, item_id, similarity, place): the `k` nearest items of each subject, by a comparison with all.

    `subjects` has entity_id and vector, `items` item_id and embedding; those without a vector are left out.
    """
    usable = lambda c: F.coalesce(F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    asked = neighbours.checkpointed(ordering.numbered(neighbours.checkpointed(subjects.filter(usable("vector")).select("entity_id", "vector")), [], ["entity_id"], "rank"))
    held = neighbours.checkpointed(ordering.numbered(items.filter(usable("embedding")).select("item_id", F.col("embedding").alias("vector")), [], ["item_id"], "rank"))
    found = tiles.top_k(neighbours.checkpointed(tiles.tiles(asked)), neighbours.checkpointed(tiles.tiles(held)), k)
    named = found.join(asked.select("rank", "entity_id"), "rank").drop("rank")
    return named.join(held.select(F.col("rank").alias("target"), "item_id"), "target").select("entity_id", "item_id", "similarity", "place")


def _line(s: Column) -> Column:
    """A source as prompts carry it."""
    part = lambda label, value: F.concat(F.lit(f" {label}: "), F.coalesce(value.cast("string"), F.lit("unknown")))
    return F.concat(F.lit("[item_id: "), s["item_id"], F.lit("]"), part("Title", s["title"]), part("Source", s["source"]), part("CCIR", s["ccir"]), part("Score", s["score"]), F.when(F.coalesce(s["summary"], F.lit("")) != "", F.concat(F.lit("\nSummary: "), s["summary"])).otherwise(""))


def prompt(name: Column, cited: Column) -> Column:
    """What a model is asked for a page: the subject and its sources, or a stub where there are none."""
    rules = "Write a short article about the topic from the articles below and nothing else. Cite each claim as [item_id]. Draw on sources of every language, and name contradictions."
    full = F.concat(F.lit(f"{rules}\n\nTopic: "), name, F.lit("\n\nArticles:\n"), F.array_join(F.transform(cited, _line), "\n"))
    return F.when(F.size(cited) > 0, full).otherwise(F.concat(F.lit("There are no items for '"), name, F.lit("'. Say in one sentence that no sources are available.")))


#: Characters of a body that a recall's prompt carries.
BODY = 500


def recall_prompt(topic: Column, cited: Column, bodies: bool = False) -> Column:
    """What a model is asked about a topic: the items that a recall has found, nearest first, with the beginnings of their bodies if wanted."""
    rules = "Answer the query from the articles below and nothing else. Cite each claim as [item_id]. Draw on sources of every language, and name contradictions. If they do not answer it, say so."
    body = lambda s: F.when(F.coalesce(s["body"], F.lit("")) != "", F.concat(F.lit("\nBody: "), F.left(s["body"], F.lit(BODY)))).otherwise("")
    told = F.transform(cited, (lambda s: F.concat(_line(s), body(s))) if bodies else _line)
    return F.concat(F.lit(f"{rules}\n\nQuery: "), topic, F.lit("\n\nArticles:\n"), F.array_join(told, "\n"))


def left_out(cited: Column, synthesis: Column) -> Column:
    """Sorted languages of the sources of which a synthesis cites none, as `[id]` or `[id: title]`."""
    ids = F.transform(F.regexp_extract_all(synthesis, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda c: F.trim(F.element_at(F.split(c, ":"), 1)))
    known = F.filter(cited, lambda s: F.coalesce(~s["lang"].isin("", "unknown"), F.lit(False)))
    heard = F.transform(F.filter(known, lambda s: F.array_contains(ids, s["item_id"])), lambda s: s["lang"])
    return F.array_sort(F.array_except(F.array_distinct(F.transform(known, lambda s: s["lang"])), heard))


def slug(name: Column) -> Column:
    return F.left(F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]+", "-"), "^-+|-+$", "")), F.lit(50))


def pages(subjects: DataFrame, items: DataFrame, embed: Callable[[Column], Column], answer: Callable[[Column], Column], others: list[str], at: Column, k: int = SOURCES) -> DataFrame:
    """(entity_id, name, file, text, meta, sources): a page for each of `subjects` (entity_id, name).

    `items` has item_id, title, url, source, ccir, score, summary, lang, bucket, embedding; skipped ones
    are no sources. `others` are the names to link to, a registry of bounded size. `meta` is the page's
    front matter, as names and JSON values in order.
    """
    asked = neighbours.checkpointed(subjects.select("entity_id", "name").withColumn("vector", embed(F.concat(F.lit(QUERY), "name"))))
    usable = items.filter("bucket <> 'skip'")
    near = sources(asked, usable, k).join(usable.select("item_id", "title", "url", "source", "ccir", "score", "summary", "lang"), "item_id")
    gathered = near.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "title", "url", "source", "ccir", "score", "summary", "lang"))).alias("sources"))  # k rows a page
    empty = F.array().cast(gathered.schema["sources"].dataType)
    rows = asked.drop("vector").join(gathered, "entity_id", "left").withColumn("sources", F.coalesce("sources", empty))
    told = neighbours.checkpointed(rows.withColumn("synthesis", F.coalesce(answer(prompt(F.col("name"), F.col("sources"))), F.lit(""))))
    missing = left_out(F.col("sources"), F.col("synthesis"))
    before, _, after = FLAG.partition("{}")
    flag = F.when(F.size(missing) > 0, F.concat(F.lit(before), F.array_join(missing, ", "), F.lit(after))).otherwise("")
    body = notes.linked(F.concat("synthesis", flag), F.array_except(F.array(*[F.lit(n) for n in others]).cast("array<string>"), F.array("name")))
    listed = F.array_join(F.transform(F.filter("sources", lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: F.concat(F.lit("- ["), F.coalesce(s["title"], F.lit("")), F.lit("]("), s["url"], F.lit(")"))), "\n")
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), body, F.lit("\n\n## Sources\n\n"), listed, F.lit("\n"))
    ids = F.transform("sources", lambda s: s["item_id"])
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    facts = (("title", quoted("name")), ("subject", quoted("name")), ("generated_at", quoted(at.cast("string"))), ("source_count", F.size("sources").cast("string")), ("sources", F.to_json(ids)))
    meta = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts])
    return told.select("entity_id", "name", F.concat(slug(F.col("name")), F.lit(".md")).alias("file"), text.alias("text"), meta.alias("meta"), ids.alias("sources"))


def write_pages(made: DataFrame, folder: str) -> None:
    """Write pages to a folder that all tasks reach. Front matter that an earlier version has besides is kept."""
    from lantern.sinks.files import merged_page

    spark = made.sparkSession
    fs, place = notes.filesystem(folder)
    fs.create_dir(place, recursive=True)
    # Only the files of these pages are read, each where its page is.
    merge = F.udf(lambda file, meta, text: merged_page(_old(folder, file), {m.key: m.value for m in meta}, text), "string")
    notes.register(spark)
    notes.write(made.select(F.col("file").alias("name"), merge("file", "meta", "text").alias("text")), folder)


def _old(folder: str, file: str) -> str:
    fs, place = notes.filesystem(folder)
    if fs.get_file_info(f"{place}/{file}").is_file:
        with fs.open_input_stream(f"{place}/{file}") as held:
            return held.read().decode()
    return ""
