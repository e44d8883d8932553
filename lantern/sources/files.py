"""Items from files: Markdown clips, subscription lists, verdict logs, JSON lists, blobs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = "t long, source string, title string, url string, ccir string, cnr string, pmesii string, tessoc string, score int, why string"
ITEM = "source string, title string, summary string, url string, lang string, ts string"
_FRONT = r"(?s)^---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|$)"


def front_matter(text):
    """(meta, body) of a text column: `key: value` lines between whole-line `---` marks, and the rest.

    Without a closing mark there is no front matter and everything is body.
    """
    head = F.regexp_extract(text, _FRONT, 1)
    has = text.rlike(_FRONT)
    lines = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(lines, lambda line: F.struct(F.trim(F.regexp_extract(line, r"^([^:]+):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("v")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    meta = F.when(has, F.map_from_entries(first)).otherwise(F.create_map().cast("map<string,string>"))
    return meta, F.when(has, F.regexp_replace(text, _FRONT, "")).otherwise(text)


def markdown_clips(spark: SparkSession, folder: str) -> DataFrame:
    """(path, meta, text) of the Markdown files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    meta, body = front_matter(F.col("value"))
    return rows.select("path", meta.alias("meta"), body.alias("text"))


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """(category, title, url) of subscription lists: feeds below a folder at any depth; loose ones are skipped."""
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                try:
                    body = ElementTree.fromstring(value).find("body")
                except ElementTree.ParseError:
                    continue
                for folder in [] if body is None else body.findall("outline"):
                    if folder.get("type") == "rss":
                        continue
                    name = (folder.get("title") or folder.get("text") or "").strip()
                    for feed in folder.iter("outline"):
                        if feed.get("type") == "rss" and feed.get("xmlUrl"):
                            rows.append((name, (feed.get("title") or feed.get("text") or "").strip(), feed.get("xmlUrl")))
            yield pd.DataFrame(rows, columns=["category", "title", "url"])

    return files.mapInPandas(run, "category string, title string, url string")


def verdict_log(spark: SparkSession, path: str, cutoff: int) -> DataFrame:
    """Verdicts of a JSON-lines log from an epoch second on; lines that can't be read are dropped."""
    return spark.read.schema(VERDICT).option("mode", "DROPMALFORMED").json(path).filter(F.col("t") >= cutoff)


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a file that holds one JSON list."""
    return spark.read.schema(ITEM).option("multiLine", True).json(path)


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(hash, data) of a folder of blobs; files whose names aren't their hashes are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return rows.select(name.alias("hash"), F.col("content").alias("data")).filter(F.sha2("data", 256) == F.col("hash"))


def requirement_texts(markdown: str) -> dict[str, str]:
    """The text of each requirement in a Markdown guide: from its bullet to the next bullet of any kind, or heading."""
    found: dict[str, list[str]] = {}
    now: str | None = None
    for line in markdown.splitlines():
        bullet = re.match(r"\s*[-*]\s+(?:\*\*)?((?:PIR|SIR|FFIR)-\d+)\b(.*)", line)
        if bullet:
            now = bullet[1]
            found[now] = [bullet[2].strip(" *:—-")]
        elif re.match(r"\s*[-*]\s|#", line) or not line.strip():
            now = None
        elif now:
            found[now].append(line.strip())
    return {k: " ".join(p for p in v if p) for k, v in found.items()}
