"""Packages: the same input gives the same bytes, and damage is refused."""

import io
import json
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.operators.steps import Step
from tidemill.sources import package
from tidemill.sources.package import PackageError, archive, manifest_of, read_package, verify_archive, write_package

STEPS = (Step("add_column", {"name": "twice", "expression": "spend * 2"}), Step("drop_columns", {"columns": ["note"]}), Step("filter_rows", {"column": "id", "operator": "lt", "value": "950"}))


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("spend"), F.concat(F.lit("plan "), F.col("id") % 3).alias("plan"), F.lit("x").alias("note"), (F.col("id") % 2 == 0).alias("churned"))


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(package, "PART_ROWS", 300)


@pytest.fixture(scope="module")
def whole(table, tmp_path_factory):
    folder = tmp_path_factory.mktemp("package") / "p"
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(package, "PART_ROWS", 300)
        write_package(table, str(folder), STEPS)
    return folder


@pytest.fixture
def made(whole, tmp_path, small_parts):
    return shutil.copytree(whole, tmp_path / "p")


def test_round_trip(spark, table, tmp_path, small_parts):
    m = write_package(table, str(tmp_path / "p"), STEPS)
    assert (m["rows"], [p["part"] for p in m["parts"]], m["required_columns"]) == (950, [0, 1, 2, 3], ["id", "spend", "plan", "churned"])
    assert m["lineage"]["twice"] == {"sources": ["spend"], "steps": [1]}
    spend = next(p for p in m["profile"] if p["column"] == "spend")
    assert spend["missing"] == 136 and spend["median"] == pytest.approx(sorted(i * 1.5 for i in range(950) if i % 7)[407] / 2 + sorted(i * 1.5 for i in range(950) if i % 7)[406] / 2)
    rows = read_package(spark, str(tmp_path / "p"), keep_order=True).orderBy("__row__").collect()
    assert [r["id"] for r in rows] == list(range(950)) and [r["__row__"] for r in rows] == list(range(950)) and rows[2]["twice"] == 6.0


def test_same_input_same_bytes(spark, table, tmp_path, small_parts):
    # The same rows in the same order, from other partitions.
    write_package(table.coalesce(1), str(tmp_path / "a"), STEPS)
    write_package(spark.createDataFrame(table.orderBy("id").collect(), table.schema), str(tmp_path / "b"), STEPS)
    a, b = archive(spark, str(tmp_path / "a")), archive(spark, str(tmp_path / "b"))
    assert a == b and verify_archive(a)["rows"] == 950
    write_package(table.orderBy(F.desc("id")), str(tmp_path / "c"), STEPS)
    assert archive(spark, str(tmp_path / "c")) != a


def test_empty_tables_and_nested_columns(spark, table, tmp_path):
    m = write_package(table.filter("false"), str(tmp_path / "e"))
    assert m["rows"] == 0 and read_package(spark, str(tmp_path / "e")).schema == table.schema and verify_archive(archive(spark, str(tmp_path / "e"))) == m
    with pytest.raises(Exception, match="fingerprint"):
        write_package(table.select(F.array("id").alias("l")), str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()


def rewrite(made, change):
    """The manifest with a change, as one line again."""
    (file,) = (made / "manifest").glob("part-*.txt")
    body = json.loads(file.read_text())
    change(body)
    file.write_text(json.dumps(body))
    for crc in made.rglob(".*.crc"):
        crc.unlink()


def drop_file(made, k):
    (file,) = (made / "data" / f"__part__={k}").glob("*.parquet")
    file.unlink()


def flip(made):
    (file,) = (made / "data" / "__part__=1").glob("*.parquet")
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    for crc in made.rglob(".*.crc"):
        crc.unlink()


def put(name, value):
    return lambda made: rewrite(made, lambda b: b.__setitem__(name, value))


DAMAGE = {
    "no manifest": lambda m: shutil.rmtree(m / "manifest"),
    "no data": lambda m: shutil.rmtree(m / "data"),
    "no JSON": lambda m: next((m / "manifest").glob("part-*.txt")).write_text("{") and [c.unlink() for c in m.rglob(".*.crc")],
    "another format": put("format", "other"),
    "a later version": put("version", 2),
    "a field is missing": lambda m: rewrite(m, lambda b: b.pop("lineage")),
    "a part is missing": lambda m: drop_file(m, 1),
    "a part is extra": lambda m: shutil.copytree(m / "data" / "__part__=1", m / "data" / "__part__=9"),
    "a byte is other": flip,
    "a foreign file": lambda m: shutil.copy(next((m / "data" / "__part__=1").glob("*.parquet")), m / "data" / "x.parquet"),
    "other rows": put("rows", 949),
    "other fingerprint": put("fingerprint", "0" * 64),
    "other recipe": lambda m: rewrite(m, lambda b: b["recipe"][0]["params"].__setitem__("expression", "spend * 3")),
    "unreadable schema": lambda m: rewrite(m, lambda b: b["schema"].pop("fields")),
    "other schema": lambda m: rewrite(m, lambda b: b["schema"]["fields"][0].__setitem__("type", "integer")),
    "lineage of nothing": lambda m: rewrite(m, lambda b: b["lineage"]["twice"].__setitem__("sources", ["gone"])),
    "lineage of a step beyond": lambda m: rewrite(m, lambda b: b["lineage"]["twice"].__setitem__("steps", [9])),
    "profile of another column": lambda m: rewrite(m, lambda b: b["profile"].pop()),
}


@pytest.mark.parametrize("damage", DAMAGE)
def test_damage_is_refused(spark, made, damage):
    DAMAGE[damage](made)
    with pytest.raises(PackageError):
        read_package(spark, str(made))


def test_damaged_archives_are_refused(spark, made):
    archived = archive(spark, str(made))

    def with_members(change):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(archived)) as z, zipfile.ZipFile(out, "w") as to:
            for name, content in change({n: z.read(n) for n in z.namelist()}).items():
                to.writestr(name, content)
        return out.getvalue()

    bad = [b"", archived[:-40], b"PK\x03\x04" + b"x" * 100, with_members(lambda m: {k: v for k, v in m.items() if "00001" not in k}), with_members(lambda m: m | {"data/part-00009.parquet": b"x"}), with_members(lambda m: m | {"../evil": b"x"}), with_members(lambda m: m | {"data/part-00001.parquet": b"x"}), with_members(lambda m: {k: v for k, v in m.items() if k != "manifest.json"})]
    for data in bad:
        with pytest.raises(PackageError):
            verify_archive(data)
    assert verify_archive(archived) == manifest_of(spark, str(made)) and isinstance(made, Path)
