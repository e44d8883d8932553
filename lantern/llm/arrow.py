"""Adding columns that a Python function computes from the text, batch by batch through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def schema(*parts: StructField | str) -> StructType:
    """A schema of fields (such as `df.schema["doc_id"]`, whatever its type) and DDL texts."""
    fields: list[StructField] = []
    for part in parts:
        fields += _parse_datatype_string(part).fields if isinstance(part, str) else [StructField(part.name, part.dataType)]
    return StructType(fields)


def map_rows(df: DataFrame, function: Callable[[Iterator[dict]], Iterable[dict]], ddl: str | StructType, rows: int = 512) -> DataFrame:
    """`mapInArrow` for a function from an iterator of rows (as dicts) to rows of the schema `ddl` (text or StructType).

    One batch of input and at most `rows` rows of output are in memory at a time.
    """
    schema = schema_of(ddl)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):  # Python objects of a few rows at a time
                    part = batch.slice(start, 256)
                    names, columns = part.schema.names, [c.to_pylist() for c in part.columns]
                    for row in zip(*columns):
                        yield dict(zip(names, row))

        held: list[dict] = []
        for row in function(values()):
            held.append(row)
            if len(held) >= rows:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], ddl: str | StructType) -> DataFrame:
    """`mapInArrow` for a function from record batches to dicts of equally long arrays, one for each column of `ddl`."""
    schema = schema_of(ddl)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, keep: list[str], column: str, function: Callable[[object], dict], ddl: str) -> DataFrame:
    """The columns `keep` of `df`, untouched, and those (`ddl`) that `function` gives for each value of `column`.

    256 rows at a time become Python objects, and of these only `column`; what is kept stays Arrow.
    """
    added = schema_of(ddl)
    target = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                new = pa.RecordBatch.from_pylist([function(v) for v in part.column(len(keep)).to_pylist()], schema=target)
                names = [*part.schema.names[: len(keep)], *target.names]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new.columns], names=names)

    source = df.select(*keep, column)
    return source.mapInArrow(run, StructType([*(source.schema[c] for c in keep), *added.fields]))
