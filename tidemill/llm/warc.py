"""WARC archives: a writer of gzip members and a splittable reader.

Each record is a gzip member of its own. The reader cuts files into byte ranges; a
task looks for the gzip magic in its range, accepts a candidate only if its first
bytes unpack to a WARC header, and from there on follows member after member. It
owns the records that start inside its range and reads the last one to its end,
however far that lies beyond.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chunks, map_batches, saved, scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
#: A writer starts another file beyond this size.
FILE_BYTES = 1 << 30
_BLOCK = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an absolute path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str, level: int) -> bytes:
    http = _HTTP.format(len(payload)).encode()
    revisit = first is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else record_name(page_id)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(first)), ("X-Refers-To-Page", str(first)), ("X-Payload-Length", str(len(payload)))]
    return _member(headers, http if revisit else http + payload, level)


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in ``folder``; the manifest
    ``(path, bytes, records)`` of the files is returned.

    A payload is the html in UTF-8, null counts as empty. Of the records with equal
    payloads of ``least_bytes`` or more that with the smallest page_id is a
    response, the others revisit it (repeated rows of that page_id are responses,
    too, as are rows without page_id). Each task attempt writes files under new
    names and only a finished one gets into the manifest, so repeated attempts
    leave nothing double."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("key"), F.octet_length(payload).alias("size"))
    # Only ids and digests meet at a payload that many pages share; the payloads themselves
    # meet their revisits by page, and stay where they are if Spark finds these small enough to send.
    repeated = keyed.filter(F.col("size") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    revisits = keyed.select("page_id", "key").join(saved(repeated, "repeated"), "key").filter("first < page_id").distinct()
    told = keyed.join(saved(revisits, "revisits"), ["page_id", "key"], "left").select("page_id", "url", "payload", "first")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in chunks(batches, "payload"):
            for page_id, url, body, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                member = _record(page_id, url, body.encode(), first, date, level)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = done.append((name, size, n))
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=schema.names)

    return saved(map_batches(told, write, schema), "manifest")


class _Forward:
    """A file read forward through one buffer: each byte is fetched once, unless a
    damaged member sends the reader back."""

    def __init__(self, file):
        self.file, self.base, self.data = file, 0, b""

    def piece(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at`` on, fewer at the end of the file."""
        if not self.base <= at <= self.base + len(self.data):
            self.base, self.data = at, b""
        while len(self.data) < at - self.base + n:
            self.file.seek(self.base + len(self.data))
            if not (raw := self.file.read(max(_BLOCK, n))):
                break
            self.base, self.data = at, self.data[at - self.base :] + raw
        return self.data[at - self.base : at - self.base + n]

    def find(self, at: int, end: int) -> int:
        """Where the gzip magic starts next in [at, end); ``end`` if nowhere."""
        while at < end:
            raw = self.piece(at, 1 << 16)
            if (k := raw.find(MAGIC)) >= 0:
                return min(at + k, end)
            if len(raw) < len(MAGIC):
                break
            at += len(raw) - len(MAGIC) + 1
        return end

    def unpack(self, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
        """The member that starts at ``at`` and the offset behind it; None if there
        is none. With ``head_only`` just its beginning."""
        unpack, out, here, n = zlib.decompressobj(31), [], at, 4096
        try:
            while not unpack.eof:
                if not (raw := self.piece(here, n)):
                    return None
                here, n = here + len(raw), min(2 * n, _BLOCK)
                out.append(unpack.decompress(raw, 64 if head_only else 0))
                if head_only:
                    break
        except zlib.error:
            return None
        return b"".join(out), here - len(unpack.unused_data)


def members(file, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, content) of the WARC members that start in [start, end)."""
    source, at, synced = _Forward(file), start, False
    while at < end:
        if not synced:
            at = source.find(at, end)
            head = source.unpack(at, head_only=True) if at < end else None
            if head is None or not head[0].startswith(b"WARC/"):
                at += 1
                continue
        whole = source.unpack(at)
        if whole is None or not whole[0].startswith(b"WARC/"):
            synced = False  # damaged: look for the next one
            at += 1
            continue
        yield at, whole[1], whole[0]
        at, synced = whole[1], True


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return fields, rest[: int(length)] if length.isdigit() else rest


RECORDS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("record_type", T.StringType())]
    + [T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("digest", T.StringType())]
)


def read_records(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives ``files(path, bytes)``, each once.

    ``payload`` is the block without its HTTP header, ``digest`` its base32 SHA-1. Ranges are dealt out evenly,
    one archive may feed many tasks; no file is read by one task alone. An empty
    list of files gives no rows; a damaged member is passed over."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = saved(ranges, "ranges")
    many = max(1, ranges.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = open_store(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(inner) as file:
                    for at, after, content in members(file, start, min(start + split_bytes, size)):
                        fields, block = parse(content)
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                        rows.append((path, at, after - at, fields.get("warc-type"), list(fields.items()), payload, digest(payload)))
                        held += len(payload)
                        if held >= 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return map_batches(ranges.repartition(many), read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=RECORDS.names)


def archive_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages``, read the archives back, and tell for each page
    page_id, payload_bytes, payload_digest, record_type and refers_to.

    A response's digest is that of the payload read back, a revisit's the one that
    its header names."""
    manifest = write_pages(pages, scratch_path(spark, "warc"))
    f = F.col("fields")
    stored = F.col("record_type") == "response"
    named = F.regexp_replace(f["warc-payload-digest"], "^sha1:", "")
    return read_records(manifest).select(
        f["x-page-id"].cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(f["x-payload-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(stored, F.col("digest")).otherwise(named).alias("payload_digest"),
        "record_type",
        f["x-refers-to-page"].cast("long").alias("refers_to"),
    )
