"""Reports as files: digests, notes, feeds and subscription lists.

A report is small by its nature (top-k lists, one note an item); rows come to the driver one by one
through an iterator, and every file is written beside its place and then moved there.
"""

from __future__ import annotations

import os
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as T
from lantern.operators import aggregates
from lantern.plans import taxonomy


def replace_file(path: str | Path, content: str) -> None:
    """Write a file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(content)
    os.replace(name, path)


def render_list(items: DataFrame) -> str:
    """Items of score 8 and more, best first."""
    rows = items.filter("score >= 8").orderBy(F.col("score").desc(), "item_id").select("score", "title", "url", "source")
    return "\n".join(["# list", "", *(f"- **[{r.score}] {r.title}** — [{r.url}]({r.url}) _{r.source}_" for r in rows.toLocalIterator())]) + "\n"


def render_links(items: DataFrame) -> str:
    """A line for each URL of the items, best first; items without one keep a line."""
    haystack = F.concat_ws(" ", "title", "summary", "body")
    rows = items.orderBy(F.coalesce("score", F.lit(0)).desc(), "item_id").select("score", "title", "source", F.transform(T.outbound_urls(haystack), T.trim_url).alias("urls"))
    lines = ["# links", ""]
    for r in rows.toLocalIterator():
        lines += [f"- **[{r.score}] {r.title}** — [{u}]({u}) _{r.source}_" for u in r.urls] or [f"- **[{r.score}] {r.title}** — (no outbound URL) _{r.source}_"]
    return "\n".join(lines) + "\n"


def render_clusters(items: DataFrame, members: DataFrame, first: int | None = None) -> str:
    """Clusters per requirement, by best score and size; `first` of each section, or all."""
    joined = members.join(items.select("item_id", "source", "score", "cnr", "title"), "item_id")
    summary = aggregates.cluster_summary(joined)
    order = [F.col("max_score").desc(), F.col("size").desc(), F.col("cluster").asc()]
    top = aggregates.top_per_group(summary, "ccir", first or 2**31 - 1, order)
    rows = top.join(items.select(F.col("item_id").alias("lead"), "title", "url"), "lead").join(F.broadcast(taxonomy.dimension(items.sparkSession).select("ord", "ccir")), "ccir", "left")
    lines, now = ["# cluster"], None
    for r in rows.orderBy(F.col("ord").asc_nulls_last(), "ccir", "rank").toLocalIterator():
        if r.ccir != now:
            now = r.ccir
            lines += ["", f"## {now} — {taxonomy.title(now)}"]
        lines.append(f"- [{r.max_score}] {r.title} ({r['size']} items, {', '.join(r.sources)}) [{r.url}]({r.url})")
    return "\n".join(lines) + "\n"


def render_brief(items: DataFrame, members: DataFrame) -> str:
    """The first tier's alerts, then six clusters per requirement, then ten routine items."""
    from lantern.operators import views

    urgent = items.filter("cnr = 'I'").orderBy(F.col("score").desc(), "item_id").select("score", "title", "url").toLocalIterator()
    routine = views.routine(items).orderBy(F.coalesce("score", F.lit(0)).desc(), "item_id").limit(10).select("title", "url").toLocalIterator()
    parts = ["# brief", "", "## CAT I", *(f"- [{r.score}] {r.title} [{r.url}]({r.url})" for r in urgent), "", render_clusters(views.kept(items), members, 6), "## Routine", *(f"- {r.title} [{r.url}]({r.url})" for r in routine)]
    return "\n".join(parts) + "\n"


def render_bluf(items: DataFrame, synthesize: Callable[[str, list[str]], str], budget: int = 6000, n: int = 5) -> str:
    """A bottom line for each requirement, by an injected function of its title and best items."""
    order = [F.col("score").desc(), F.col("item_id").asc()]
    picked = aggregates.within_budget(items.filter("score >= 8"), "ccir", F.concat_ws(" ", "title", "why"), budget, n, order)
    grouped = picked.groupBy("ccir").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda s: s["title"]).alias("titles"))
    lines = ["# bluf"]
    for r in grouped.orderBy("ccir").toLocalIterator():
        try:
            line = synthesize(taxonomy.title(r.ccir), list(r.titles)) or "(no summary)"
        except Exception as error:  # a model that fails leaves its place marked
            line = f"(no summary: {type(error).__name__})"
        lines += ["", f"## {r.ccir}", line]
    return "\n".join(lines) + "\n"


def write_digests(folder: str | Path, items: DataFrame, members: DataFrame, synthesize: Callable[[str, list[str]], str]) -> list[str]:
    """Twelve files: brief, cluster, list and bluf for all items, the operational and the intelligence picture."""
    from lantern.operators import views

    written = []
    for suffix, view in (("", None), ("-cop", "cop"), ("-cip", "cip")):
        chosen = views.view(items, view)
        own = members.join(chosen.select("item_id"), "item_id", "left_semi")
        for name, render in (("brief", lambda: render_brief(chosen, own)), ("cluster", lambda: render_clusters(views.kept(chosen), own)), ("list", lambda: render_list(chosen)), ("bluf", lambda: render_bluf(chosen, synthesize))):
            replace_file(Path(folder) / f"{name}{suffix}.md", render())
            written.append(f"{name}{suffix}.md")
    return written


def write_notes(folder: str | Path, items: DataFrame) -> int:
    """A note for each kept item, named after its id; the tasks write them (`notes`). Returns how many there are."""
    from lantern.operators import views
    from lantern.sinks import notes

    kept = views.vault_keep(items)
    notes.write(notes.item_notes(kept), str(folder))
    return kept.count()


def atom_document(title: str, updated: str, entries: list, feed_id: str | None = None) -> str:
    """An Atom feed of entries with id, title, url, at and summary."""
    feed = ET.Element("feed", xmlns="http://www.w3.org/2005/Atom")
    for name, value in (("title", title), ("updated", updated), ("id", feed_id)):
        if value is not None:
            ET.SubElement(feed, name).text = value
    for e in entries:
        entry = ET.SubElement(feed, "entry")
        ET.SubElement(entry, "id").text = e["id"]
        ET.SubElement(entry, "title").text = e["title"] or ""
        ET.SubElement(entry, "link", href=e["url"] or "")
        ET.SubElement(entry, "updated").text = e["at"]
        ET.SubElement(entry, "summary").text = e["summary"] or ""
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(feed, encoding="unicode") + "\n"


def atom_feed(items: DataFrame, title: str, limit: int = 50) -> str:
    """An Atom feed of the newest feed and video items; its time is the newest item's."""
    rows = items.filter(F.col("source_type").isin("rss", "yt")).orderBy(F.col("ts").desc(), F.col("item_id").desc()).limit(limit)
    entries = rows.select(F.concat(F.lit("urn:sha256:"), "item_id").alias("id"), "title", "url", "summary", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).collect()
    return atom_document(title, entries[0]["at"] if entries else "1970-01-01T00:00:00Z", entries)


def working_subscriptions(feeds: DataFrame) -> str:
    """A subscription list of the feeds (category, title, url, status) that are live or only pausing."""
    parts, now = [], None
    for r in feeds.filter(F.col("status").isin("ok", "transient")).orderBy("category", F.lower("title"), "url").toLocalIterator():
        if r.category != now:
            parts += ["</outline>"] * (now is not None) + [f'<outline text="{escape(r.category or "")}">']
            now = r.category
        parts.append(f'<outline type="rss" text="{escape(r.title or "")}" xmlUrl="{escape(r.url or "")}"/>')
    return '<?xml version="1.0" encoding="utf-8"?>\n<opml version="2.0"><body>' + "".join(parts) + "</outline>" * (now is not None) + "</body></opml>\n"


def merged_page(old: str, meta: dict[str, str], body: str) -> str:
    """A page whose front matter is the old page's with the new values over it."""
    kept: dict[str, str] = {}
    lines = old.split("\n")
    if lines and lines[0].rstrip() == "---" and "---" in [x.rstrip() for x in lines[1:]]:
        for line in lines[1 : [x.rstrip() for x in lines].index("---", 1)]:
            key, colon, value = line.partition(":")
            if colon:
                kept[key.strip()] = value.strip()
    kept.update(meta)
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in kept.items()) + "---\n" + body


def deliver(payloads: Iterable[dict], send: Callable[[dict], None], sleep: Callable[[float], None], waits: tuple[float, ...] = (1.0, 5.0)) -> list[tuple[dict, str]]:
    """(payload, delivered or dlx): three attempts each, with waits between them."""
    out = []
    for payload in payloads:
        outcome = "dlx"
        for wait in (*waits, None):
            try:
                send(payload)
                outcome = "delivered"
                break
            except Exception:
                if wait is not None:
                    sleep(wait)
        out.append((payload, outcome))
    return out
