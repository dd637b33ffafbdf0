"""Media columns: texts or bytes kept as lossless WebP pictures, and pictures read
back to pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm import webp
from tidemill.llm.common import byte_column, chunks, free_name, map_batches

UNIT = 64
_OPAQUE, _EIGHT = np.uint32(0xFF000000), np.uint32(8)


def pad(payload: np.ndarray) -> np.ndarray:
    """``payload`` with zeros up to a positive multiple of UNIT bytes."""
    return np.concatenate([payload, np.zeros(-len(payload) % UNIT if len(payload) else UNIT, np.uint8)])


def to_pictures(padded: np.ndarray) -> bytes:
    """Grey pictures (samples in the green channel), one RIFF file after another.

    Rows have 64 samples; what the format's 16384 rows cannot hold starts another
    file, so that reading needs the memory of one such picture, however long the
    payload. A palette is used for 16 sample values or fewer."""
    out, most = [], UNIT * webp.MAX_SIDE
    for at in range(0, len(padded), most):
        part = padded[at : at + most]
        few = np.count_nonzero(np.bincount(part, minlength=256)) <= 16
        pixels = (_OPAQUE | part.astype(np.uint32) << _EIGHT).reshape(-1, UNIT)
        out.append(webp.encode(pixels, (webp.PALETTE,) if few else ()))
    return b"".join(out)


def _files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        if len(media) < at + 8:
            raise webp.WebPError("the file is cut off")
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield media[at:end]
        at = end


def from_pictures(media: bytes) -> np.ndarray:
    """The samples that ``to_pictures`` stored."""
    return np.concatenate([(webp.decode(x) >> _EIGHT).astype(np.uint8).ravel() for x in _files(media)])


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, n_bytes, media)``; null counts as empty.
    Texts are stored whole, whatever their length; equal texts give equal media."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = byte_column(batch.column(1))
            media = [to_pictures(pad(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=schema.names)

    return map_batches(docs.select("doc_id", "text"), store, schema)


def feature(samples: np.ndarray) -> str:
    """Integer figures of the samples: number, sum, sum of squares, distinct
    values, sum of steps between neighbours."""
    wide = samples.astype(np.int64)
    return f"n={len(wide)};sum={wide.sum()};sq={(wide * wide).sum()};distinct={np.count_nonzero(np.bincount(samples, minlength=256))};steps={np.abs(np.diff(wide)).sum()}"


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of what the stored media hold."""
    schema = T.StructType(
        [stored.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
        + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            rows = []
            for media in batch.column(2).to_pylist():
                samples = from_pictures(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return map_batches(stored.select("doc_id", "n_bytes", "media"), read, schema)


def decode_pixels(pictures: DataFrame, media: str = "media") -> DataFrame:
    """``pictures`` with ``width``, ``height`` and ``pixels`` (ARGB as signed
    ints, row by row); underscores in front of names that clash.

    Several files of one width, one after another (as ``store_texts`` makes of long
    texts), are one picture, the rows of one below those of the other. Null media, bytes
    that are no lossless WebP file, and what has anything else behind give nulls."""
    names = [free_name(pictures, x) for x in ("width", "height", "pixels")]
    schema = T.StructType([*pictures.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.ArrayType(T.IntegerType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, media):
            width, height, pixels = [], [], []
            for value in batch.column(batch.schema.get_field_index(media)).to_pylist():
                try:
                    picture = None if value is None else np.concatenate([webp.decode(x) for x in _files(value)])
                except (ValueError, IndexError, struct.error):  # broken streams too
                    picture = None
                width.append(None if picture is None else picture.shape[1])
                height.append(None if picture is None else picture.shape[0])
                pixels.append(None if picture is None else picture.view(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(pixels, pa.list_(pa.int32()))], names=[*batch.schema.names, *names])

    return map_batches(pictures, read, schema)
