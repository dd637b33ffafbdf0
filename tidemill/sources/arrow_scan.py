"""Arrow IPC and Feather files as a Spark data source: one partition a record batch.

The footer alone tells schema and batches, so planning reads no data, and a file of
ten batches is read by ten tasks. Files are opened by pyarrow's own file systems
(local paths, s3, gs, hdfs); stores that only Spark reaches are read a file a task by
``readers``."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.errors import PreparationError

NAME = "tidemill_arrow"
FOOTERS_AT_ONCE = 32


def opened(path: str):
    """A random-access file, of which only what is asked for is read."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def footer(path: str) -> tuple[pa.Schema, int]:
    """Schema and number of record batches."""
    with opened(path) as file:
        try:
            source = pa.ipc.open_file(file)
        except pa.ArrowInvalid as e:
            raise PreparationError(f"{path} is no Arrow file: {e}") from None
        return source.schema, source.num_record_batches


def plain_type(kind: pa.DataType) -> pa.DataType:
    """The type that Spark holds the values in: dictionaries are their values, wide
    and view types the usual ones, unsigned numbers the next signed ones."""
    if pa.types.is_dictionary(kind):
        return plain_type(kind.value_type)
    if pa.types.is_large_string(kind) or str(kind) == "string_view":
        return pa.string()
    if pa.types.is_large_binary(kind) or str(kind) == "binary_view":
        return pa.binary()
    if pa.types.is_large_list(kind) or pa.types.is_list(kind):
        return pa.list_(plain_type(kind.value_type))
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_date64(kind):
        return pa.date32()
    if pa.types.is_float16(kind):
        return pa.float32()
    unsigned = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    return unsigned.get(kind, kind)


def plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, plain_type(f.type), True) for f in schema])


def conformed(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batch in the types of ``schema``."""
    columns = [c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in batch.columns]
    yield from pa.table(columns, names=batch.schema.names).cast(schema, safe=False).to_batches()


@dataclass
class Batch(InputPartition):
    path: str
    number: int


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema):
        self.paths, self.schema = paths, schema

    def partitions(self) -> list[Batch]:
        with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
            found = list(pool.map(footer, self.paths))
        for path, (schema, _) in zip(self.paths, found):
            if plain_schema(schema).names != self.schema.names:
                raise PreparationError(f"{path} has other columns than {self.paths[0]}")
        return [Batch(path, i) for path, (_, n) in zip(self.paths, found) for i in range(n)] or [Batch("", -1)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        with opened(partition.path) as file:
            batch = pa.ipc.open_file(file).get_batch(partition.number)
        yield from conformed(batch, self.schema)


class ArrowFiles(DataSource):
    """``spark.read.format("tidemill_arrow").option("paths", <JSON list>)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _paths(self) -> list[str]:
        return json.loads(self.options.get("paths", "[]")) or [self.options["path"]]

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(plain_schema(footer(self._paths()[0])[0]), prefer_timestamp_ntz=True)

    def reader(self, schema: T.StructType) -> ArrowReader:
        return ArrowReader(self._paths(), plain_schema(footer(self._paths()[0])[0]))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(NAME).option("paths", json.dumps(paths)).load()
