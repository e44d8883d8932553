"""Notes by tasks, writes of several tables that are seen whole or not at all, pages of entities."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lantern.operators import store, wiki
from lantern.sinks import notes, tables

ARTICLE = "item_id string, title string, body string, created_at long"


def visible(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_notes_are_written_by_tasks(spark, tmp_path):
    rows = [(f"a/{i}", f'T "{i}"', "see Oslo and Oslo Havn http://x/Oslo", "s", "http://u", dt.datetime(2024, 5, 1), "PIR-1", "I", i, "read", None, ["Oslo", "Oslo Havn"] if i % 2 else None) for i in range(40)]
    items = spark.createDataFrame(rows, "item_id string, title string, summary string, source string, url string, ts timestamp, ccir string, cnr string, score int, bucket string, why string, entities array<string>").repartition(5)
    notes.write(notes.item_notes(items), str(tmp_path))
    assert visible(tmp_path) == sorted(f"a{i}.md" for i in range(40)) and len(list(tmp_path.iterdir())) == 40
    odd = (tmp_path / "a1.md").read_text()
    assert odd.startswith('---\nbucket: "read"\nccir: "PIR-1"\ncnr: "I"\ndate: "2024-05-01T00:00:00Z"\nitem_id: "a/1"\nscore: 1\nsource: "s"\ntitle: "T \\"1\\""\nurl: "http://u"\n---\n\n\n## Summary\n')
    assert "see [[Oslo]] and [[Oslo Havn]] http://x/Oslo\n\n## Source\ns — [les](http://u)\n\n## Why\n\n\n## Entities\nOslo, Oslo Havn\n" in odd
    assert "see Oslo and" in (tmp_path / "a2.md").read_text() and notes.NO_ENTITIES in (tmp_path / "a2.md").read_text()
    with pytest.raises(Exception, match="no name of a note"):
        notes.write(spark.createDataFrame([("../x", "t")], "name string, text string"), str(tmp_path))


def test_two_tables_change_together(spark, tmp_path):
    path = str(tmp_path / "store")
    assert tables.read(spark, path, "articles", ARTICLE).count() == 0
    for n in range(3):
        rows = spark.createDataFrame([(f"i{i}", f"title {n}", "text" if n else " ", n) for i in range(n, 50)], ARTICLE).repartition(4)
        tables.append(path, articles=rows, audit=store.audit(rows, "put_item", "articles", ["title"]))
    held = tables.read(spark, path, "articles", ARTICLE)
    assert held.groupBy("seq").count().orderBy("seq").collect() == [(0, 50), (1, 49), (2, 48)]
    now = {r.item_id: (r.title, r.created_at, r.body) for r in store.upserted_items(held).collect()}
    assert now["i0"] == ("title 0", 0, None) and now["i1"] == ("title 1", 0, "text") and now["i9"] == ("title 2", 0, "text")
    assert tables.read(spark, path, "audit", "op string, item_id string, details string").count() == 147


def test_nothing_of_a_failed_write_is_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    good = spark.createDataFrame([("a", "t", None, 1)], ARTICLE)
    tables.append(path, articles=good)

    @F.udf("string")
    def fails(value):
        if value == "i77":
            raise ValueError("stop")
        return value

    bad = spark.range(0, 100, 1, 4).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("t").alias("title"), F.lit("b").alias("body"), "id").select("item_id", "title", "body", F.col("id").alias("created_at"))
    with pytest.raises(Exception, match="stop"):
        tables.append(path, articles=bad.withColumn("title", fails("item_id")), audit=bad.select("item_id"))
    assert [r.item_id for r in tables.read(spark, path, "articles", ARTICLE).collect()] == ["a"]
    assert tables.read(spark, path, "audit", "item_id string").count() == 0


def test_a_killed_attempt_stays_hidden(spark, tmp_path):
    """What an attempt has written before it was killed isn't seen, though a later one of the same write is committed."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    path = str(tmp_path / "store")
    schema = StructType([StructField(tables.TABLE, StringType()), StructField("item_id", StringType())])
    writer = tables.TablesWriter(path, schema)
    batch = lambda *ids: pa.RecordBatch.from_pydict({tables.TABLE: ["articles"] * len(ids), "item_id": list(ids)})
    lost, kept = writer.write(iter([batch("x", "y")])), writer.write(iter([batch("x", "y"), batch("z")]))
    assert tables.read(spark, path, "articles", "item_id string").count() == 0
    writer.commit([kept, None])
    assert sorted(r.item_id for r in tables.read(spark, path, "articles", "item_id string").collect()) == ["x", "y", "z"]
    assert len(lost.files) == 1 and len(kept.files) == 1
    with pytest.raises(ValueError, match="no name of a table"):
        writer.write(iter([pa.RecordBatch.from_pydict({tables.TABLE: ["../x"], "item_id": ["a"]})]))


def test_pages_of_the_entities_that_a_batch_touches(spark, tmp_path):
    vectors = {"Oslo": [1.0, 0.0], "NATO": [0.0, 1.0], "Bergen": [0.7, 0.7]}
    items = [(f"i{n}", f"Title {n}", f"http://u/{n}" if n % 3 else None, "s", "PIR-1", n, "sum" if n % 2 else None, "no" if n % 2 else "ru", "skip" if n == 5 else "read", [1.0, n / 10]) for n in range(30)] + [("none", "t", None, "s", None, 1, None, None, "read", None)]
    held = spark.createDataFrame(items, "item_id string, title string, url string, source string, ccir string, score int, summary string, lang string, bucket string, embedding array<double>")
    names = spark.createDataFrame([("e1", "Oslo"), ("e2", "NATO"), ("e3", "Bergen")], "entity_id string, name string")
    links = spark.createDataFrame([("e1", "i1"), ("e2", "i2"), ("e1", "i9"), ("e3", "i8")], "entity_id string, item_id string")
    batch = held.filter("item_id IN ('i1', 'i2')")
    chosen = names.join(wiki.touched(links, batch), "entity_id", "left_semi")
    embed = lambda c: F.when(c == "query: Oslo", F.array(F.lit(1.0), F.lit(0.0))).when(c == "query: NATO", F.array(F.lit(0.0), F.lit(1.0)))
    asked = []

    @F.udf("string")
    def answer(prompt):
        return "About NATO and Oslo [i1] [i3: Title 3]" if "Topic: Oslo" in prompt and "[item_id: i0]" in prompt else "Nothing on Bergen."

    made = wiki.pages(chosen, held, embed, answer, ["Oslo", "NATO", "Bergen"], F.lit("2024-05-01"), k=4)
    rows = {r.name: r for r in made.collect()}
    assert set(rows) == {"Oslo", "NATO"} and vectors and asked == []
    assert rows["Oslo"].sources == ["i0", "i1", "i2", "i3"] and rows["NATO"].sources == ["i29", "i28", "i27", "i26"]
    assert rows["Oslo"].text == "# Oslo\n\nAbout [[NATO]] and Oslo [i1] [i3: Title 3]" + wiki.FLAG.format("ru") + "\n\n## Sources\n\n- [Title 1](http://u/1)\n- [Title 2](http://u/2)\n"
    assert rows["NATO"].text.startswith("# NATO\n\nNothing on [[Bergen]]." + wiki.FLAG.format("no, ru"))
    (tmp_path / "oslo.md").write_text("---\nowner: me\ntitle: old\n---\nold body")
    wiki.write_pages(made, str(tmp_path))
    page = (tmp_path / "oslo.md").read_text()
    assert page.startswith('---\nowner: me\ntitle: "Oslo"\nsubject: "Oslo"\ngenerated_at: "2024-05-01"\nsource_count: 4\nsources: ["i0","i1","i2","i3"]\n---\n# Oslo') and "old body" not in page
    assert visible(tmp_path) == ["nato.md", "oslo.md"]


def test_a_subject_without_sources_is_a_stub(spark):
    items = spark.createDataFrame([], "item_id string, title string, url string, source string, ccir string, score int, summary string, lang string, bucket string, embedding array<double>")
    made = wiki.pages(spark.createDataFrame([("e", "Ø / x")], "entity_id string, name string"), items, lambda c: F.array(F.lit(1.0)), lambda c: c, [], F.lit("now"))
    row = made.first()
    assert row.file == "ø-x.md" and row.sources == [] and row.text.startswith("# Ø / x\n\nThere are no items for 'Ø / x'.")
