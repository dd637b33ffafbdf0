"""Reading tables: format and encoding detection, then Spark's own readers."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tidemill.errors import PreparationError
from tidemill.functions.expressions import quoted
from tidemill.sources import arrow_scan

PROBE, TEXT_PROBE, SEPARATORS, MAX_DEPTH = 8 * 1024, 1 << 20, ",;\t|", 100
_BY_NAME = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "xlsx", ".feather": "arrow", ".arrow": "arrow", ".ipc": "arrow", ".orc": "orc"}
#: Stores whose files pyarrow opens by itself.
ARROW_STORES = ("/", "file:", "s3://", "gs://", "hdfs://")
_BY_MAGIC = ((b"PAR1", "parquet"), (b"ARROW1", "arrow"), (b"PK\x03\x04", "xlsx"), (b"ORC", "orc"))


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, through Spark, so any store works. For a
    folder, those of its first file."""
    if "://" not in path and Path(path).is_file():
        with open(path, "rb") as f:
            return f.read(size)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if store.getFileStatus(at).isDirectory():
        names = sorted(s.getPath().toString() for s in store.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        if not names:
            return b""
        at = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = store.open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_format(path: str, start: bytes) -> str:
    """Magic bytes win over the extension; text formats hold no NUL."""
    for magic, kind in _BY_MAGIC:
        if start.startswith(magic):
            return kind
    kind = _BY_NAME.get(Path(path.rstrip("/")).suffix.lower())
    if kind in ("parquet", "arrow", "xlsx", "orc") and start:
        raise PreparationError(f"{path} is no {kind} file")
    if kind is None:
        raise PreparationError(f"the format of {path} is not known")
    if b"\0" in start[: 64 * 1024] and not start.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise PreparationError(f"{path} is binary, not text")
    return kind


def detect_encoding(start: bytes) -> str:
    """UTF-8 if it decodes, UTF-16 by its mark, then Cyrillic by letter share."""
    if start.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        start.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if e.start >= len(start) - 4:  # a character cut by the probe's end
            return "UTF-8"
    text = start.decode("cp1251", "replace")
    letters = [c for c in text if c.isalpha()]
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in letters)
    return "windows-1251" if cyrillic >= 3 and cyrillic >= 0.05 * len(letters) else "windows-1252"


def sniff_separator(start: bytes, encoding: str) -> str:
    try:
        return csv.Sniffer().sniff(start[:PROBE].decode(encoding, "replace"), SEPARATORS).delimiter
    except csv.Error:
        return ","


def json_depth(start: bytes) -> int:
    deepest = depth = 0
    inside = escaped = False
    for b in start:
        if inside:
            if escaped:
                escaped = False
            elif b == 0x5C:
                escaped = True
            elif b == 0x22:
                inside = False
        elif b == 0x22:
            inside = True
        elif b in b"[{":
            depth += 1
            deepest = max(deepest, depth)
        elif b in b"]}":
            depth -= 1
    return deepest


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema=None) -> DataFrame:
    """A file or folder as a DataFrame. CSV rows that are too long or short are
    cut or filled with nulls, values that do not fit the schema become null."""
    start = head(spark, path, TEXT_PROBE)
    kind = kind or detect_format(path, start)
    if kind in ("csv", "tsv"):
        encoding = detect_encoding(start)
        single = encoding.startswith("windows")
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", "\"").option("encoding", "ISO-8859-1" if single else encoding).option("sep", "\t" if kind == "tsv" else sniff_separator(start, encoding))
        df = reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
        return _recoded(df, encoding, rename=schema is None) if single else df
    if kind in ("json", "jsonl"):
        if json_depth(start) > MAX_DEPTH:
            raise PreparationError("the JSON is nested too deeply")
        reader = spark.read if schema is None else spark.read.schema(schema)
        whole = kind == "json" and start.lstrip()[:1] == b"["
        return reader.option("multiLine", whole).json(path)
    if kind in ("parquet", "orc"):
        return (spark.read if schema is None else spark.read.schema(schema)).format(kind).load(path)
    if kind == "arrow":
        return _read_arrow(spark, path)
    if kind == "xlsx":
        return _read_xlsx(spark, path)
    raise PreparationError(f"the format {kind!r} is not known")


def _recoded(df: DataFrame, encoding: str, rename: bool) -> DataFrame:
    """Text that was read as Latin-1, in its real single-byte encoding. Spark's
    readers know few charsets, but each byte became one character, so a
    translation of 128 characters does it."""
    raw = bytes(range(0x80, 0x100))
    there = "".join(bytes([b]).decode(encoding, "replace") for b in raw)
    here = raw.decode("latin-1")
    names = [c.translate(str.maketrans(here, there)) for c in df.columns] if rename else df.columns
    return df.select(*((F.translate(quoted(f.name), here, there) if isinstance(f.dataType, T.StringType) else quoted(f.name)).alias(n) for f, n in zip(df.schema, names)))


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, one partition a record batch (``arrow_scan``). From a store
    that pyarrow does not know each file is read in the task that holds its row."""
    files = spark.read.format("binaryFile").load(path)
    paths = sorted(r["path"] for r in files.select("path").collect())
    if not paths:
        raise PreparationError(f"there is no Arrow file in {path}")
    if all(p.startswith(ARROW_STORES) for p in paths):
        return arrow_scan.scan(spark, paths)
    import pyarrow as pa

    def footer_schema(batches):
        for batch in batches:
            for content in batch.column(0):
                source = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([arrow_scan.plain_schema(source.schema).serialize().to_pybytes()])], names=["s"])

    first = files.orderBy("path").limit(1).select("content").mapInArrow(footer_schema, "s binary").first()["s"]
    plain = pa.ipc.read_schema(pa.py_buffer(bytes(first)))
    shape = from_arrow_schema(plain, prefer_timestamp_ntz=True)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                source = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(source.num_record_batches):
                    yield from arrow_scan.conformed(source.get_batch(i), plain)

    return files.select("content").mapInArrow(read, shape)


def _read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; needs the optional package openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError:
        raise PreparationError("reading XLSX needs openpyxl") from None
    return spark.createDataFrame(pd.read_excel(path, sheet_name=0))
