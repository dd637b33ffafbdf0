"""Tables that are replaced as a whole: written aside, then committed by a record.

``<table>/data/<version>-<random>`` holds the rows, ``<table>/commits/<version>-<random>``
one record. Readers follow the last whole record; a run that dies, whenever it does,
leaves the table as it was. Both are written by Spark's own writers, so any store that
Spark writes to serves."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.sources.readers import detect_format, head, read_table

#: Goes up when the same source would give other rows.
CONVERTER, CONVERTER_VERSION = "tidemill", 1
WARNINGS = {"xlsx": ("only the first sheet is read",), "csv": ("types are inferred",), "tsv": ("types are inferred",), "json": ("types are inferred",), "jsonl": ("types are inferred",)}


@dataclass(frozen=True)
class Commit:
    version: int
    data: str
    rows: int
    source: str
    source_state: str
    source_format: str
    converter: str
    converter_version: int
    created_at: str
    warnings: tuple[str, ...] = ()


def source_state(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the source's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    rows = files.agg(F.sort_array(F.collect_list(F.sha2(F.concat_ws("|", "path", "length", "at"), 256))).alias("h")).first()["h"]
    return hashlib.sha256("".join(rows).encode()).hexdigest()


def commits(spark: SparkSession, table: str) -> list[Commit]:
    """All whole records, the oldest first; none for a table that was never committed."""
    try:
        lines = [r[0] for r in spark.read.option("recursiveFileLookup", True).text(f"{table}/commits").collect()]
    except AnalysisException:
        return []
    found = []
    for line in lines:
        try:
            body = json.loads(line)
            found.append(Commit(**{**body, "warnings": tuple(body["warnings"])}))
        except (ValueError, TypeError, KeyError):
            continue  # of another make, or cut
    return sorted(found, key=lambda c: (c.version, c.created_at, c.data))


def current(spark: SparkSession, table: str) -> Commit | None:
    return (commits(spark, table) or [None])[-1]


def read_current(spark: SparkSession, table: str) -> DataFrame:
    last = current(spark, table)
    if last is None:
        raise PreparationError(f"{table} holds no committed version")
    return spark.read.parquet(last.data)


def commit(df: DataFrame, table: str, source: str = "", state: str = "", kind: str = "", expected: int | None = None) -> Commit:
    """Write ``df`` as the table's next version. With ``expected`` the last version
    must still be that one when the rows are written, or nothing is committed."""
    spark = df.sparkSession
    last = current(spark, table)
    version = (last.version if last else 0) + 1
    if expected is not None and version != expected + 1:
        raise PreparationError(f"{table} is at version {version - 1}, not {expected}")
    data = f"{table}/data/{version:08d}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(data)
    rows = spark.read.schema(df.schema).parquet(data).count()
    now = current(spark, table)
    if (now.version if now else 0) + 1 != version:
        raise PreparationError(f"{table} was committed by another run meanwhile")
    record = Commit(version, data, rows, source, state, kind, CONVERTER, CONVERTER_VERSION, dt.datetime.now(dt.UTC).isoformat(), WARNINGS.get(kind, ()))
    line = spark.createDataFrame([(json.dumps(asdict(record), ensure_ascii=False),)], "value string").coalesce(1)
    line.write.mode("errorifexists").text(f"{table}/commits/{version:08d}-{uuid.uuid4().hex}")
    return record


def normalise(spark: SparkSession, source: str, table: str, kind: str | None = None, again: bool = False) -> Commit:
    """The source file or folder as the table's current Parquet version.

    A version that was made by this converter version from the source as it is now is
    kept (``again`` makes a new one all the same). The source is never touched."""
    kind = kind or detect_format(source, head(spark, source, 1 << 16))
    state, last = source_state(spark, source), current(spark, table)
    if not again and last and (last.source_state, last.converter, last.converter_version) == (state, CONVERTER, CONVERTER_VERSION):
        return last
    return commit(read_table(spark, source, kind), table, source, state, kind)


def is_stale(spark: SparkSession, table: str) -> bool:
    """Whether the source or the converter changed since the last commit."""
    last = current(spark, table)
    return last is None or last.converter_version != CONVERTER_VERSION or bool(last.source) and last.source_state != source_state(spark, last.source)
