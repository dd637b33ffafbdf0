"""Writing tables: exports and their content fingerprint (``package`` has packages)."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import quoted
from tidemill.operators.rows import ORDER, with_order

# Fixed value: text that a spreadsheet would run as a formula.
FORMULA = r"^([=@\t\r]|[+-].*[^0-9\s.,()/+\-])"
STREAMED, GATHERED = ("csv", "tsv", "parquet", "jsonl", "orc"), ("json", "xlsx", "feather", "arrow")
GATHER_LIMIT = 1_000_000


def neutralised(df: DataFrame) -> DataFrame:
    """Text that starts a formula gets an apostrophe in front."""
    return df.select(*(F.when(quoted(f.name).rlike(FORMULA), F.concat(F.lit("'"), quoted(f.name))).otherwise(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in df.schema))


def without_zone(df: DataFrame) -> DataFrame:
    """Zoned timestamps as UTC wall-clock times."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return df.select(*(F.to_utc_timestamp(quoted(f.name), zone).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else quoted(f.name) for f in df.schema))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write ``df``: streamed formats as a folder of parts by all tasks; gathered
    ones as one file by the driver, and only up to GATHER_LIMIT rows, which are
    counted first (more is refused, never cut)."""
    df = df.drop(ORDER)
    if kind in ("csv", "tsv"):
        neutralised(df).write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind in ("parquet", "orc"):
        df.write.mode("overwrite").option("compression", "zstd").format(kind).save(path)
    elif kind in GATHERED:
        if df.limit(GATHER_LIMIT + 1).count() > GATHER_LIMIT:
            raise PreparationError(f"{kind} takes {GATHER_LIMIT} rows at most; choose csv, parquet or jsonl")
        _gather(df, path, kind)
    else:
        raise PreparationError(f"there is no export format {kind!r}")


def _gather(df: DataFrame, path: str, kind: str) -> None:
    if kind == "json":
        rows = [json.loads(r) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False)
    elif kind == "xlsx":
        try:
            import openpyxl  # noqa: F401
        except ImportError:
            raise PreparationError("writing XLSX needs openpyxl") from None
        without_zone(df).toPandas().to_excel(path, index=False)
    else:
        import pyarrow.feather as feather

        feather.write_feather(df.toArrow(), path, compression="zstd")


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value as text that is equal for equal content: NaN is one value, -0 is 0."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(F.isnan(d), "NaN").when(d == 0, "0.0").otherwise(d.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise PreparationError(f"columns of type {kind.simpleString()} have no fingerprint")
    return c.cast("string")


def fingerprint(df: DataFrame, block_rows: int = 100_000) -> str:
    """SHA-256 of content, row order included.

    Rows hash on the executors; blocks of consecutive rows combine to one hash
    each, and the driver hashes the list of blocks (64 bytes for every
    ``block_rows`` rows)."""
    full = with_order(df)
    fields = [f for f in full.schema if f.name != ORDER]
    cells = [F.coalesce(F.concat(F.lit("="), canonical(quoted(f.name), f.dataType)), F.lit("-")) for f in fields]
    hashed = full.select(quoted(ORDER).alias("o"), F.sha2(F.to_json(F.array(*cells)), 256).alias("h"))
    part = F.shiftright("o", 33)
    place = F.row_number().over(Window.partitionBy("p").orderBy("o")) - 1
    blocks = hashed.withColumn("p", part).withColumn("b", F.floor(place / block_rows)).groupBy("p", "b").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("o", "h"))).alias("rows"))
    digests = blocks.select("p", "b", "n", F.sha2(F.array_join(F.col("rows.h"), ""), 256).alias("d")).orderBy("p", "b").collect()
    head = [[unicodedata.normalize("NFC", f.name), f.dataType.simpleString()] for f in fields]
    return hashlib.sha256(json.dumps([sum(r["n"] for r in digests), head, [r["d"] for r in digests]], ensure_ascii=False).encode()).hexdigest()
