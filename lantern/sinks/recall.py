"""What a recall search found, as a table, a note or JSON; and the feed of one video channel.

A search gives at most k hits. Spark ranks them, writes a line for each, and brings lines and hits into
one row, which is all that the driver gets.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lantern.operators import aggregates, vectors
from lantern.sinks.files import atom_document, replace_file

# Headings, the columns of the table, what stands for no hits, and how a note flags languages that a synthesis leaves out.
HEADING, NOTHING, SYNTHESIS = '## Recall: "{}" ({})\n', "No results found for '{}'.", "\n## Synthesis\n\n"
COLUMNS = ("#", "Title", "Source", "CCIR", "Score", "Similarity")
RULE = "|---|-------|--------|------|-------|------------|"
FLAG = "\n\n> ⚠️ **Verification Flag**: {} language sources were present but not cited."
HIT = ("item_id", "title", "url", "source", "ccir", "score", "similarity", "lang")


def summary(found: DataFrame) -> Row:
    """One row for all hits: their number, `hits` (structs without texts) and `lines` of the table, from the nearest on."""
    name = F.when(F.coalesce("url", F.lit("")) != "", F.format_string("[%s](%s)", "title", "url")).otherwise(F.col("title"))
    cells = [F.col("rank").cast("string"), name, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("source", "ccir", "score")], F.col("similarity")]
    kept = [c for c in HIT if c in found.columns]
    ranked = vectors.recall_table(found).select("item_id", F.struct("rank", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).alias("shown"))
    rows = found.select("item_id", F.struct(*kept).alias("hit")).join(ranked, "item_id")
    ordered = F.array_sort(F.collect_list(F.struct("shown", "hit")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda r: r["hit"]).alias("hits"), F.transform(ordered, lambda r: r["shown"]["line"]).alias("lines")).first()


def as_json(found: DataFrame) -> str:
    return json.dumps(summary(found).asDict(recursive=True)["hits"], indent=2, ensure_ascii=False)


def _shown(held: Row, topic: str, since: str | None) -> str:
    if held.n == 0:
        return NOTHING.format(topic)
    return HEADING.format(topic, since or "all time") + "\n" + "\n".join(("| " + " | ".join(COLUMNS) + " |", RULE, *held.lines))


def as_table(found: DataFrame, topic: str, since: str | None = None) -> str:
    return _shown(summary(found), topic, since)


def flagged(found: DataFrame, synthesis: str) -> str:
    """A synthesis with a flag for the languages of the hits that it doesn't cite."""
    missing = aggregates.missing_languages(found, F.lit(synthesis)).first().missing
    return synthesis + (FLAG.format(", ".join(missing)) if missing else "")


def write_note(folder: str | Path, found: DataFrame, topic: str, day: dt.date, since: str | None = None, synthesize: Callable[[list[dict]], str] | None = None) -> str:
    """A note named after the topic and the day: hits as JSON front matter, the table, and a synthesis if one is asked for."""
    held = summary(found)
    hits = held.asDict(recursive=True)["hits"]
    front = {"topic": topic, "since": since, "count": held.n, "results": hits}
    text = f"---\n{json.dumps(front, indent=2, ensure_ascii=False)}\n---\n\n{_shown(held, topic, since)}"
    if synthesize is not None:
        text += "\n" + SYNTHESIS + flagged(found, synthesize(hits))
    name = f"recall-{topic.translate(str.maketrans(' /', '--'))[:50]}-{day}.md"
    replace_file(Path(folder) / name, text)
    return name


def channel_feed(videos: DataFrame, title: str, feed_id: str, now: dt.datetime, limit: int = 50) -> str:
    """An Atom feed of one channel's newest videos (video_id, title, description, published)."""
    newest = videos.orderBy(F.col("published").desc(), "video_id").limit(limit)
    entries = newest.select(F.concat(F.lit("urn:youtube:"), "video_id").alias("id"), "title", F.concat(F.lit("https://youtu.be/"), "video_id").alias("url"), F.lit(now.isoformat()).alias("at"), F.col("description").alias("summary"))
    return atom_document(title, now.isoformat(), entries.collect(), feed_id)
