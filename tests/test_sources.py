"""Arrow files by record batch, tables replaced by commits, and values as JSON."""

import datetime as dt
import json
import os
import subprocess
import sys
import time
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.codec import MAX_TEXT, NotStorable, decode, encode
from tidemill.sources import arrow_scan, versions
from tidemill.sources.readers import read_table

ROOT = Path(__file__).resolve().parent.parent


def arrow_file(path, rows=100, each=10):
    table = pa.table({"i": pa.array(range(rows), pa.int64()), "word": pa.array([f"w{i % 3}" for i in range(rows)]).dictionary_encode(), "u": pa.array(range(rows), pa.uint64()), "t": pa.array([dt.datetime(2020, 1, 1, 0, 0, i % 60) for i in range(rows)], pa.timestamp("ns")), "l": pa.array([[i] for i in range(rows)], pa.large_list(pa.int32()))})
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        for b in table.to_batches(max_chunksize=each):
            out.write_batch(b)


def test_a_partition_for_each_record_batch(spark, tmp_path):
    arrow_file(tmp_path / "a.arrow")
    df = read_table(spark, str(tmp_path / "a.arrow"))
    assert df.rdd.getNumPartitions() == 10
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "decimal(20,0)", "timestamp_ntz", "array<int>"]
    rows = df.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(100)) and rows[4] == (4, "w1", Decimal(4), dt.datetime(2020, 1, 1, 0, 0, 4), [4])


def test_folders_and_feather(spark, tmp_path):
    for k in range(3):
        arrow_file(tmp_path / f"{k}.arrow", 20, 5)
    assert read_table(spark, str(tmp_path), "arrow").count() == 60
    feather.write_feather(pa.table({"x": [1.5, None], "y": ["a", "b"]}), str(tmp_path / "z.feather"))
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "z.feather")).collect()), key=str) == [(1.5, "a"), (None, "b")]
    arrow_file(tmp_path / "none.arrow", 0)
    assert read_table(spark, str(tmp_path / "none.arrow")).count() == 0


def test_schema_needs_no_data(tmp_path):
    """The footer is read, the batches are not: they may be damaged."""
    arrow_file(tmp_path / "a.arrow", 1000, 100)
    raw = bytearray((tmp_path / "a.arrow").read_bytes())
    raw[2000:8000] = bytes(6000)
    (tmp_path / "a.arrow").write_bytes(raw)
    schema, batches = arrow_scan.footer(str(tmp_path / "a.arrow"))
    assert schema.names == ["i", "word", "u", "t", "l"] and batches == 10
    (tmp_path / "b.arrow").write_bytes(b"ARROW1 but no more")
    with pytest.raises(PreparationError):
        arrow_scan.footer(str(tmp_path / "b.arrow"))


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    arrow_file(tmp_path / "a.arrow")
    monkeypatch.setattr("tidemill.sources.readers.ARROW_STORES", ("nowhere:",))
    assert sorted(r["i"] for r in read_table(spark, str(tmp_path / "a.arrow")).collect()) == list(range(100))


def test_normalise_keeps_what_is_up_to_date(spark, tmp_path):
    source, table = tmp_path / "a.csv", str(tmp_path / "t")
    source.write_text("a,b\n1,x\n2,y\n")
    one = versions.normalise(spark, str(source), table)
    assert (one.version, one.rows, one.source_format, one.converter_version) == (1, 2, "csv", versions.CONVERTER_VERSION) and one.warnings
    assert versions.normalise(spark, str(source), table) == one and not versions.is_stale(spark, table)
    source.write_text("a,b\n1,x\n2,y\n3,z\n")
    assert versions.is_stale(spark, table)
    two = versions.normalise(spark, str(source), table)
    assert (two.version, two.rows) == (2, 3) and versions.read_current(spark, table).count() == 3
    assert spark.read.parquet(one.data).count() == 2 and source.read_text().endswith("3,z\n")
    assert versions.normalise(spark, str(source), table, again=True).version == 3


def test_a_version_from_another_converter_is_made_anew(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "a.csv", str(tmp_path / "t")
    source.write_text("a\n1\n")
    versions.normalise(spark, str(source), table)
    monkeypatch.setattr(versions, "CONVERTER_VERSION", 2)
    assert versions.is_stale(spark, table) and versions.normalise(spark, str(source), table).version == 2


def test_a_failed_run_leaves_the_table(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(PreparationError):
        versions.read_current(spark, table)
    versions.commit(spark.range(5).toDF("x"), table)
    with pytest.raises(Exception, match="stop here"):
        versions.commit(spark.range(5).select(F.raise_error(F.lit("stop here")).alias("x")), table)
    assert versions.read_current(spark, table).count() == 5
    with pytest.raises(PreparationError, match="version 1"):
        versions.commit(spark.range(9).toDF("x"), table, expected=0)
    # A record that is cut, or names no rows, is passed over.
    os.makedirs(f"{table}/commits/00000009-x")
    Path(f"{table}/commits/00000009-x/part-0.txt").write_text('{"version": 9, "data": "' + table)
    assert versions.read_current(spark, table).count() == 5
    assert versions.commit(spark.range(7).toDF("x"), table, expected=1).version == 2


def test_a_killed_run_leaves_the_table(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.commit(spark.range(5).toDF("x"), table)
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tidemill.sources import versions
slow = s.range(0, 2000, 1, 200).select(F.udf(lambda i: __import__("time").sleep(0.05) or i, "long")("id").alias("x"))
versions.commit(slow, {table!r})
"""
    run = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        end = time.time() + 90
        while not list(Path(table, "data").glob("00000002-*/_temporary/**/*.parquet")):
            assert time.time() < end and run.poll() is None
            time.sleep(0.2)
    finally:
        os.killpg(run.pid, 9)
        run.wait()
    assert versions.current(spark, table).version == 1 and versions.read_current(spark, table).count() == 5
    assert versions.commit(spark.range(6).toDF("x"), table).version == 2 and versions.read_current(spark, table).count() == 6


VALUES = [
    (T.StringType(), ["", "a", "Ünï \U0001f600", "it's \"so\"\n"]), (T.BooleanType(), [True, False]), (T.LongType(), [0, -(2**63), 2**63 - 1]), (T.ByteType(), [-128, 127]), (T.DoubleType(), [0.1, -1e308, 5e-324]), (T.FloatType(), [0.5, 0.10000000149011612]),
    (T.DecimalType(38, 18), [Decimal("12345678901234567890.123456789012345678"), Decimal("-0.000000000000000001")]), (T.DateType(), [dt.date(1, 1, 1), dt.date(9999, 12, 31)]), (T.TimestampNTZType(), [dt.datetime(2020, 1, 1, 0, 0, 0, 1), dt.datetime(1999, 12, 31, 23, 59, 59, 999999)]),
    (T.TimestampType(), [dt.datetime(2020, 1, 1, 12, 0, 0, 1)]), (T.DayTimeIntervalType(), [dt.timedelta(days=-3, microseconds=7), dt.timedelta(0)]), (T.BinaryType(), [b"", b"\x00\xff"]),
]


@pytest.mark.parametrize(("kind", "values"), VALUES, ids=lambda x: x.simpleString() if isinstance(x, T.DataType) else "")
def test_values_select_the_same_rows_after_json(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    stored = [json.loads(json.dumps(encode(r["v"], kind))) for r in df.orderBy("i").collect()[:-1]]
    for i, s in enumerate(stored):
        assert [r["i"] for r in df.filter(F.col("v") == decode(s, kind)).collect()] == [i]


@pytest.mark.parametrize(
    ("value", "kind"),
    [(None, T.StringType()), ("x" * (MAX_TEXT + 1), T.StringType()), (float("nan"), T.DoubleType()), (float("inf"), T.FloatType()), ([1], T.ArrayType(T.IntegerType())), ({"a": 1}, T.MapType(T.StringType(), T.IntegerType())), ("1", T.LongType()), (1.5, T.LongType()), (True, T.LongType()), (1, T.StringType()), ("2020-01-01", T.DateType())],
)
def test_values_that_no_filter_holds_are_refused(value, kind):
    with pytest.raises(NotStorable):
        encode(value, kind)
