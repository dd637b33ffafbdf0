"""Packages: a prepared table with its recipe, lineage, profile and digests, and a
reader that refuses what is damaged.

``<folder>/data`` holds Parquet parts of PART_ROWS consecutive rows each, sorted by the
row's number, so equal input gives equal bytes whatever the partitioning;
``<folder>/manifest`` holds one JSON line with the digest of each part. Rows, parts and
digests are made and checked by tasks; the driver sees one line a part."""

from __future__ import annotations

import hashlib
import io
import json
import unicodedata
import zipfile
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import PreparationError
from tidemill.functions.expressions import quoted
from tidemill.functions.staging import staged
from tidemill.operators.column_stats import column_profile
from tidemill.operators.ranked import percentiles, value_counts
from tidemill.operators.rows import ORDER, ordinals, with_order
from tidemill.operators.steps import Step
from tidemill.plans.pipeline import Pipeline, check_limits, lineage, replay, required_columns
from tidemill.sources.writers import canonical

FORMAT, VERSION, PART = "tidemill.package", 1, "__part__"
PART_ROWS, MAX_ARCHIVE = 250_000, 256 << 20
_FIELDS = {"format": str, "version": int, "rows": int, "schema": dict, "parts": list, "recipe": list, "recipe_fingerprint": str, "required_columns": list, "lineage": dict, "profile": list, "fingerprint": str}


class PackageError(PreparationError):
    """A package that is damaged, of another version, or not one at all."""


def content_fingerprint(rows: DataFrame) -> str:
    """SHA-256 over all rows in the order of their numbers (column ORDER, dense):
    tasks hash blocks of PART_ROWS rows, the driver the list of blocks."""
    fields = [f for f in rows.schema if f.name not in (ORDER, PART)]
    cells = [F.coalesce(F.concat(F.lit("="), canonical(quoted(f.name), f.dataType)), F.lit("-")) for f in fields]
    hashed = rows.select(F.floor(F.col(ORDER) / PART_ROWS).alias("b"), F.struct(F.col(ORDER).alias("o"), F.sha2(F.to_json(F.array(*cells)), 256).alias("h")).alias("x"))
    blocks = hashed.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ""), 256).alias("d")).orderBy("b").collect()
    head = [[unicodedata.normalize("NFC", f.name), f.dataType.simpleString()] for f in fields]
    return hashlib.sha256(json.dumps([head, [r["d"] for r in blocks]], ensure_ascii=False).encode()).hexdigest()


def _parts(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """Number, size and digest of each file, read by tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{folder}/data")
    found = files.select(F.regexp_extract("path", f"{PART}=(\\d+)/", 1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).collect()
    if any(not r["part"] for r in found):
        raise PackageError("the package holds a file that is no part")
    return sorted(({"part": int(r["part"]), "bytes": r["bytes"], "sha256": r["sha256"]} for r in found), key=lambda x: (x["part"], x["sha256"]))


def _profile(body: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in column_profile(body).collect()]
    numbers = {f.name: quoted(f.name) for f in body.schema if isinstance(f.dataType, T.NumericType)}
    medians = {}
    if numbers:
        finite = {n: F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")) for n, c in numbers.items()}
        medians = {r["column"]: r["value"] for r in percentiles(value_counts(body, finite), [0.5]).collect()}
    return [r | {"median": medians.get(r["column"])} for r in rows]


def write_package(source: DataFrame, folder: str, steps: tuple[Step, ...] = ()) -> dict[str, Any]:
    """``source`` after ``steps`` as a package in a folder that does not exist yet; its
    manifest. Nested columns have no fingerprint and are refused before anything is
    written."""
    for f in replay(source, steps).schema:
        canonical(F.lit(None), f.dataType)
    spark = source.sparkSession
    body = staged(ordinals(with_order(replay(source, steps, keep_order=True)), "__number__").drop(ORDER).withColumnRenamed("__number__", ORDER))
    parted = body.withColumn(PART, F.floor(F.col(ORDER) / PART_ROWS).cast("int"))
    parted.repartition(PART).sortWithinPartitions(PART, ORDER).write.option("compression", "zstd").partitionBy(PART).parquet(f"{folder}/data")
    plain = body.drop(ORDER)
    pipeline = Pipeline(tuple(steps))
    manifest = {
        "format": FORMAT,
        "version": VERSION,
        "rows": body.count(),
        "schema": json.loads(plain.schema.json()),
        "parts": _parts(spark, folder) if body.count() else [],
        "recipe": [{"kind": s.kind, "params": s.params} for s in steps],
        "recipe_fingerprint": pipeline.fingerprint(),
        "required_columns": list(required_columns(source, steps)),
        "lineage": {c: {"sources": list(h.sources), "steps": list(h.steps)} for c, h in lineage(source, steps).items()},
        "profile": _profile(plain),
        "fingerprint": content_fingerprint(body),
    }
    line = json.dumps(manifest, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return json.loads(line)


def manifest_of(spark: SparkSession, folder: str) -> dict[str, Any]:
    try:
        lines = [r[0] for r in spark.read.text(f"{folder}/manifest").collect()]
    except AnalysisException:
        raise PackageError(f"{folder} holds no manifest") from None
    if len(lines) != 1:
        raise PackageError("a manifest is one line")
    return _checked(lines[0])


def _checked(line: str) -> dict[str, Any]:
    """The manifest, if it is one of this version and agrees with itself."""
    try:
        body = json.loads(line)
    except ValueError:
        raise PackageError("the manifest is no JSON") from None
    if not isinstance(body, dict) or body.get("format") != FORMAT:
        raise PackageError("this is no package")
    if body.get("version") != VERSION:
        raise PackageError(f"the package is of version {body.get('version')!r}, not {VERSION}")
    for name, kind in _FIELDS.items():
        if not isinstance(body.get(name), kind):
            raise PackageError(f"the manifest lacks {name!r}")
    try:
        schema = T.StructType.fromJson(body["schema"])
        steps = tuple(Step(s["kind"], s["params"]) for s in body["recipe"])
        check_limits(steps)
    except Exception as e:
        raise PackageError(f"schema or recipe cannot be read: {e}") from None
    if Pipeline(steps).fingerprint() != body["recipe_fingerprint"]:
        raise PackageError("the recipe is not the one that was packed")
    if set(body["lineage"]) != set(schema.names):
        raise PackageError("lineage and schema name other columns")
    known = set(body["required_columns"])
    for c, h in body["lineage"].items():
        if not set(h["sources"]) <= known or not all(isinstance(k, int) and 0 < k <= len(steps) for k in h["steps"]):
            raise PackageError(f"the lineage of {c!r} names what the recipe does not have")
    if [p["column"] for p in body["profile"]] != [f.name for f in schema if not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))] or any(p["rows"] != body["rows"] for p in body["profile"]):
        raise PackageError("profile and schema do not agree")
    if [p.get("part") for p in body["parts"]] != list(range(-(-body["rows"] // PART_ROWS))):
        raise PackageError("the parts do not hold the rows")
    return body


def read_package(spark: SparkSession, folder: str, keep_order: bool = False) -> DataFrame:
    """The rows of a package that is whole: each part's digest, the number of rows,
    their schema and their fingerprint must be those of the manifest."""
    body = manifest_of(spark, folder)
    schema = T.StructType.fromJson(body["schema"])
    if not body["rows"]:
        return spark.createDataFrame([], schema)
    try:
        found = _parts(spark, folder)
    except AnalysisException:
        raise PackageError("the package holds no data") from None
    if found != body["parts"]:
        raise PackageError("a part is missing, extra or damaged")
    rows = spark.read.parquet(f"{folder}/data").drop(PART)
    if [(f.name, f.dataType) for f in rows.schema if f.name != ORDER] != [(f.name, f.dataType) for f in schema]:
        raise PackageError("the parts have another schema")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("a"), F.max(ORDER).alias("b")).first()
    if (facts["n"], facts["a"], facts["b"]) != (body["rows"], 0, body["rows"] - 1):
        raise PackageError("the parts do not hold the rows")
    if content_fingerprint(rows) != body["fingerprint"]:
        raise PackageError("the rows are not those that were packed")
    return rows if keep_order else rows.drop(ORDER)


def archive(spark: SparkSession, folder: str) -> bytes:
    """A small package as one ZIP: equal packages give equal bytes. Beyond MAX_ARCHIVE
    bytes of parts it is refused: a folder is the form for large ones."""
    body = manifest_of(spark, folder)
    if sum(p["bytes"] for p in body["parts"]) > MAX_ARCHIVE:
        raise PackageError(f"an archive holds {MAX_ARCHIVE} bytes at most")
    members = [("manifest.json", json.dumps(body, ensure_ascii=False, sort_keys=True).encode())]
    if body["parts"]:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{folder}/data")
        for r in files.select(F.regexp_extract("path", f"{PART}=(\\d+)/", 1).cast("int").alias("part"), "content").orderBy("part").collect():
            members.append((f"data/part-{r['part']:05d}.parquet", bytes(r["content"])))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def verify_archive(data: bytes) -> dict[str, Any]:
    """The manifest of a whole archive; anything else is refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if len(names) != len(set(names)) or any(n.startswith("/") or ".." in n.split("/") for n in names):
                raise PackageError("the archive names a member twice or outside itself")
            if "manifest.json" not in names:
                raise PackageError("the archive holds no manifest")
            body = _checked(z.read("manifest.json").decode())
            wanted = {f"data/part-{p['part']:05d}.parquet": p for p in body["parts"]}
            if set(names) - {"manifest.json"} != set(wanted):
                raise PackageError("a part is missing or extra")
            for name, p in wanted.items():
                content = z.read(name)
                if len(content) != p["bytes"] or hashlib.sha256(content).hexdigest() != p["sha256"]:
                    raise PackageError(f"{name} is damaged")
    except (zipfile.BadZipFile, UnicodeDecodeError, EOFError) as e:
        raise PackageError(f"this is no whole archive: {e}") from None
    return body
