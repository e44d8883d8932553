"""Several tables that one write changes together: all of its rows are seen, or none.

Every write has an id. Its tasks write Parquet files, hidden by their names, to a folder of that
id below each table, and tell the driver their names. Only when all tasks have ended does the driver give
the files their names and then write one small commit file: that single step makes the write
visible in all tables. Readers take the folders of committed ids only, as a filter on the partition
column, so files of failed or running writes are never opened. What a killed attempt leaves is hidden
by its name even after a later attempt is committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lantern.sinks.notes import filesystem, put

#: Column of a written row that names its table; the others are of all tables, and null where a table hasn't them.
TABLE = "_table"
_FILE_ROWS = 500_000


@dataclass
class Written(WriterCommitMessage):
    """The hidden files of a task."""

    files: list[str]


class TablesSink(DataSource):
    """Batch sink `lantern_tables`: option `path`, the folder of the tables; `_table` names each row's."""

    @classmethod
    def name(cls) -> str:
        return "lantern_tables"

    def schema(self) -> str:
        return f"{TABLE} string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tables are appended to, not overwritten")
        return TablesWriter(self.options["path"], schema)


class TablesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.id = path, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        place, target = self.schema.fieldNames().index(TABLE), to_arrow_schema(self.schema)
        writers: dict[str, pq.ParquetWriter] = {}
        files: list[str] = []
        try:
            for batch in iterator:
                whole = pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, schema=target)])
                for table in whole.column(place).unique().to_pylist():
                    if table is None or not table.replace("_", "").isalnum():
                        raise ValueError(f"{table!r} is no name of a table")
                    if table not in writers:
                        folder = f"{root}/{table}/write={self.id}"
                        fs.create_dir(folder, recursive=True)
                        files.append(f"{folder}/.part-{uuid.uuid4().hex}.parquet")
                        writers[table] = pq.ParquetWriter(files[-1], whole.schema.remove(place), filesystem=fs, compression="zstd")
                    rows = whole.filter(pa.compute.equal(whole.column(place), table)).remove_column(place)
                    writers[table].write_table(rows, row_group_size=_FILE_ROWS)
        finally:
            for writer in writers.values():
                writer.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for path in (f for m in messages if m is not None for f in m.files):
            folder, _, name = path.rpartition("/")
            fs.move(path, f"{folder}/{name.removeprefix('.')}")
        fact = {"write": self.id, "number": len(_commits(fs, root)), "at": time.time()}
        put(fs, f"{root}/_commits/{fact['number']:012d}-{self.id}.json", json.dumps(fact).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for path in (f for m in messages if m is not None for f in m.files):
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)


def _commits(fs: pafs.FileSystem, root: str) -> list[str]:
    """Ids of the committed writes, in their order."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    return [n.removesuffix(".json").partition("-")[2] for n in names]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TablesSink)


def append(path: str, **tables: DataFrame) -> None:
    """Add rows to several tables below `path` in one write.

    Columns of one name must be of one type in all of them. A table that gets no rows isn't touched.
    """
    rows = None
    for name, table in tables.items():
        part = table.withColumn(TABLE, F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        return
    register(rows.sparkSession)
    rows.write.format("lantern_tables").mode("append").save(path)


def read(spark: SparkSession, path: str, table: str, ddl: str) -> DataFrame:
    """The committed rows of a table, with `seq`, the number of their write, by which later ones win."""
    fs, root = filesystem(path)
    ids = _commits(fs, root)
    if not ids or fs.get_file_info(f"{root}/{table}").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], ddl).withColumn("seq", F.lit(0).cast("long"))
    columns = spark.createDataFrame([], ddl).columns
    numbers = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "write string, seq long")
    rows = spark.read.schema(f"{ddl}, write string").parquet(f"{path}/{table}")
    return rows.filter(F.col("write").isin(*ids)).join(F.broadcast(numbers), "write").select(*columns, "seq")  # a row a write
