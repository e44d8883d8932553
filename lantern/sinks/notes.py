"""Notes written by the tasks that hold them: one file a row, each whole or not at all.

Texts are column expressions, so that a note costs no Python; only the files are written there. A
task that is repeated writes the same files again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lantern.functions import text as T

NOTE = "name string, text string"
# Fixed value: what a note shows for an item without entities.
NO_ENTITIES = "(ingen oppdaget)"
#: Front matter of an item's note, in its order.
FRONT = ("bucket", "ccir", "cnr", "date", "item_id", "score", "source", "title", "url")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a file whole or not at all: beside its place, then moved there."""
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(data)
    fs.move(beside, path)


class NotesSink(DataSource):
    """Batch sink `lantern_notes`: rows of name and text become files in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "lantern_notes"

    def schema(self) -> str:
        return NOTE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NotesWriter(self.options["path"], schema.fieldNames().index("name"), schema.fieldNames().index("text"))


class NotesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: int, text: int) -> None:
        self.path, self.name, self.text = path, name, text

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = filesystem(self.path)
        for batch in iterator:
            for name, text in zip(batch.column(self.name).to_pylist(), batch.column(self.text).to_pylist()):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"{name!r} is no name of a note")
                put(fs, f"{folder}/{name}", (text or "").encode())
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NotesSink)


def write(notes: DataFrame, folder: str) -> None:
    """Write notes (name, text) to a folder that all tasks reach. Of two notes of one name the last one written stays."""
    register(notes.sparkSession)
    notes.select("name", "text").write.format("lantern_notes").mode("append").save(folder)


def _yaml(value: Column) -> Column:
    """A scalar of front matter: numbers as they are, other values quoted as JSON, which YAML reads."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r'(["\\])', r"\\$1"), r"[\n\r\t]+", " "), F.lit('"'))
    return F.when(value.isNull(), "null").when(value.rlike(r"^-?\d{1,9}$"), value).otherwise(quoted)


def linked(text: Column, names: Column) -> Column:
    """A text with a row's own names as wiki links: the longest name first, at word boundaries, not in links or URLs."""
    longest = F.array_sort(F.filter(F.array_distinct(names), lambda n: n != ""), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.array_join(F.transform(longest, lambda n: F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|")
    keep = r"https?://\S+|\[\[[^\]]*\]\]|\[[^\]]*\]"
    marked = F.regexp_replace(text, F.concat(F.lit(rf"(?U)({keep})|\b("), pattern, F.lit(r")\b")), F.lit("$1\u0001$2\u0002"))
    done = F.regexp_replace(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001([^\u0002]*)\u0002", "[[$1]]")
    return F.when(F.size(longest) > 0, done).otherwise(text)


def item_notes(items: DataFrame) -> DataFrame:
    """(name, text): a note for each item (item_id, title, summary, source, url, ts, ccir, cnr, score, bucket, why).

    With a column `entities` (array of names), they are listed, and linked in the summary and the reason.
    """
    names = F.coalesce("entities", F.array().cast("array<string>")) if "entities" in items.columns else F.array().cast("array<string>")
    rows = items.withColumn("_names", names).withColumn("date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    front = [F.concat(F.lit(f"{c}: "), _yaml(F.col(c).cast("string")), F.lit("\n")) for c in FRONT]
    said = lambda c: linked(F.coalesce(F.col(c), F.lit("")), F.col("_names"))
    listed = F.when(F.size("_names") > 0, F.array_join("_names", ", ")).otherwise(NO_ENTITIES)
    text = F.concat(
        F.lit("---\n"), *front, F.lit("---\n\n\n## Summary\n"), said("summary"), F.lit("\n\n## Source\n"),
        F.coalesce("source", F.lit("")), F.lit(" — [les]("), F.coalesce("url", F.lit("")), F.lit(")\n\n## Why\n"), said("why"), F.lit("\n\n## Entities\n"), listed, F.lit("\n\n"),
    )
    return rows.select(T.note_name("item_id").alias("name"), text.alias("text"))
