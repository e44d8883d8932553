"""Outputs of recall, a channel's feed and translations through the cache."""

import datetime as dt
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lantern.functions import identity, models
from lantern.operators import store
from lantern.sinks import recall

HIT = "item_id string, title string, url string, source string, ccir string, score int, similarity double, lang string, body string"
HITS = [("b", "Second", None, "s2", "none", 3, 0.5, "ru", "text"), ("a", "First", "http://a", "s1", "PIR-1", 9, 0.98765, "no", "text")]


def test_table_note_and_json(spark, tmp_path):
    found = spark.createDataFrame(HITS, HIT)
    table = recall.as_table(found, "ice/cap", "7d").split("\n")
    assert table[0] == '## Recall: "ice/cap" (7d)' and table[-2:] == ["| 1 | [First](http://a) | s1 | PIR-1 | 9 | 0.988 |", "| 2 | Second | s2 | none | 3 | 0.500 |"]
    assert [r["item_id"] for r in json.loads(recall.as_json(found))] == ["a", "b"] and "body" not in recall.as_json(found)
    assert recall.as_table(found.limit(0), "x") == "No results found for 'x'."
    name = recall.write_note(tmp_path, found, "ice/cap now", dt.date(2024, 1, 2), synthesize=lambda rows: f"{len(rows)} hits, see [a: First]")
    note = (tmp_path / name).read_text()
    assert name == "recall-ice-cap-now-2024-01-02.md" and note.startswith('---\n{\n  "topic": "ice/cap now"') and note.endswith("## Synthesis\n\n2 hits, see [a: First]" + recall.FLAG.format("ru")) and "(all time)" in note


def test_channel_feed(spark):
    videos = spark.createDataFrame([("v1", "Old & new", None, 1), ("v2", "<b>", "d", 2)], "video_id string, title string, description string, published int")
    feed = ET.fromstring(recall.channel_feed(videos, "A & B", "urn:x:a", dt.datetime(2024, 1, 1), 1).encode())
    atom = "{http://www.w3.org/2005/Atom}"
    assert feed.find(atom + "title").text == "A & B" and [e.find(atom + "title").text for e in feed.findall(atom + "entry")] == ["<b>"]


def test_translations_are_asked_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "hei"), (2, "hei"), (3, "kjent"), (4, "  "), (5, None)], "id int, title string")
    known = spark.createDataFrame([("kjent", "en", "known"), ("hei", "de", "hallo")], "title string, target_lang string, translation string")
    cache = known.withColumn("text_hash", identity.text_hash(F.col("title"))).drop("title")
    asked = str(tmp_path / "asked")

    def translate(text):
        with open(asked, "a") as out:
            out.write(text + "\n")
        return f" {text.upper()} "

    out, new = store.translated(items, cache, "en", models.translator(translate))
    assert {r.id: r.translation for r in out.collect()} == {1: "HEI", 2: "HEI", 3: "known", 4: "  ", 5: None}
    assert [(r.target_lang, r.translation) for r in new.collect()] == [("en", "HEI")]
    assert open(asked).read() == "hei\n"
