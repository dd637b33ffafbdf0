"""Helpers that the corpus operators share: scratch space, Arrow text access,
64-bit mixing and word hashing in numpy."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Bytes and rows that Spark hands to a Python worker at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000
#: Files that a core writes, at most, of a table between two steps of an operator.
FILES_A_CORE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, one machine) a session may name none: then a
    temporary folder is made and set. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemill-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: the
    lineage is cut, and a lost executor costs nothing that was finished."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator saves, to drop those that its result no longer needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, label: str, merge: bool = True) -> DataFrame:
        """As ``saved``, and remembered under ``label``. With ``merge`` the partitions
        of a shuffle are written one after another by FILES_A_CORE tasks a core at
        most, which spares a small table many files."""
        if merge:
            df = df.coalesce(FILES_A_CORE * self.spark.sparkContext.defaultParallelism)
        path = scratch_path(self.spark, label)
        self.paths.append((label, path))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: tuple[str, ...] = ()) -> None:
        """Delete all saved tables but those of the labels ``but``."""
        path_of, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsparkSession.sessionState().newHadoopConf()
        for label, path in self.paths:
            if label not in but:
                at = path_of(path)
                at.getFileSystem(conf).delete(at, True)
        self.paths = [x for x in self.paths if x[0] in but]
        self.forget()

    def forget(self) -> None:
        """Spark's cleaner deletes shuffle files once nothing refers to their plans;
        collecting garbage now keeps steps from adding up on the executors' disks. As
        measured, the last job's files stay until another job ends, so one of a row runs first."""
        self.spark.range(1).count()
        gc.collect()
        self.spark._jvm.System.gc()


def map_batches(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for long texts: the session's
    limits are lowered to BATCH_BYTES and BATCH_ROWS if they are higher."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df.mapInArrow(f, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, ends, data = column.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``text`` each, but
    always one row at least: a longer text comes alone and whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = byte_column(column)[1]
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * step**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(_STEP, done, 1 << 64))
        done += take
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    Returns for each word its text's index, a 64-bit hash, and its first and
    end byte in ``data``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first, last = solid.copy(), solid.copy()
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[1:] &= ~solid[:-1]
    first[inner] |= solid[inner]
    last[:-1] &= ~solid[1:]
    last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    size = end - start
    power = _powers(int(size.max()))
    begins = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begins, size)
    values = _BYTE[low[solid]] * power[inside]
    hashed = mix(np.add.reduceat(values, begins) + size.astype(np.uint64))
    return np.searchsorted(offsets, start, side="right") - 1, hashed, start, end


_ROLL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(doc: np.ndarray, word: np.ndarray, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, hash)`` of each run of ``width`` words, in text order.

    With ``whole_if_short`` a text of fewer words gives its whole sequence as
    one shingle, which equals no shingle of another length."""
    n = len(word)
    if n == 0:
        return doc, word
    value = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        value += word[k : k + len(value)] * _ROLL[k]
    ok = doc[: len(value)] == doc[width - 1 :] if len(value) else np.zeros(0, bool)
    owner, hashed = doc[: len(value)][ok], mix(value[ok])
    if not whole_if_short:
        return owner, hashed
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[begin, n])
    short = np.flatnonzero(count < width)
    if not len(short):
        return owner, hashed
    extra = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        extra[has] += word[begin[short[has]] + k] * _ROLL[k]
    extra = mix(extra + count[short].astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    owner, hashed = np.r_[owner, doc[begin[short]]], np.r_[hashed, extra]
    order = np.argsort(owner, kind="stable")
    return owner[order], hashed[order]


def distinct_sets(owner: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text: ``(offsets of n + 1, values)``."""
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    owner, hashed = owner[keep], hashed[keep]
    return np.searchsorted(owner, np.arange(n + 1)), hashed
