"""Binary columns of lossless WebP images: bytes to images, images to pixel arrays and features.

Any bytes can be stored: they are padded with spaces to a positive multiple of 192, laid out as rows of 64 RGB pixels, and
written as one or more images of at most 16384 rows, one after the other. Reading gives the same bytes back.

Null texts count as empty ones (payload: 192 spaces). A null or broken image gives null pixels and an error, no failure, as does one of
more than webp.MAX_PIXELS pixels. Rows repeat as they come; extra columns pass through, and those named like a result are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import webp

#: Payloads are padded to a multiple of ROW bytes, one row of 64 RGB pixels.
ROW = 192
WIDTH = ROW // 3
_VALUES = np.arange(256)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def store(payload: bytes) -> bytes:
    """payload (a positive multiple of ROW bytes) as WebP images, one after the other."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return b"".join(webp.encode(rows[k : k + webp.MAX_SIDE]) for k in range(0, len(rows), webp.MAX_SIDE))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels (height, width, 4) of each image of media."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0] if len(media) >= at + 8 else 0
        if size < 20:
            raise webp.WebPError("no image")
        yield webp.decode(media[at : at + size])
        at += size


def features(parts: list[np.ndarray]) -> str:
    """Rows, and for each of R, G, B: sum, sum of squares, distinct values and the sum of steps along a row, as text; all are whole numbers."""
    pixels = np.concatenate(parts) if len(parts) > 1 else parts[0]
    out = [str(len(pixels))]
    for k in range(3):
        plane = pixels[..., k]
        counts = np.bincount(plane.ravel(), minlength=256)
        steps = np.abs(np.diff(plane.astype(np.int16), axis=1)).sum(dtype=np.int64)
        out.append(f"{counts @ _VALUES}:{counts @ (_VALUES * _VALUES)}:{np.count_nonzero(counts)}:{steps}")
    return ";".join(out)


def encode_column(df: DataFrame, column: str = "text", to: str = "media") -> DataFrame:
    """df with a binary column `to` that holds each value of `column` (string or binary) as lossless WebP; null stays null."""
    source, others = f"__{column}", [c for c in df.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 64):
            values = batch.column(source).cast(pa.binary()).to_pylist()
            media = pa.array([None if x is None else store(padded(x)) for x in values], pa.binary())
            yield batch.select(others).append_column(to, media)
        C.release_memory()

    C.bound_batches(df.sparkSession)
    given = df.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{column}`").alias(source))
    return given.mapInArrow(run, given.drop(source).withColumn(to, F.lit(None).cast("binary")).schema)


def decode_column(df: DataFrame, column: str = "media") -> DataFrame:
    """df with pixels: an array of structs (height, width, rgba binary, row by row), one for each image; error: what was wrong ("null" for null), else null."""
    images_type = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgba", pa.binary())]))
    source, others = f"__{column}", [c for c in df.columns if c not in ("pixels", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, 32):
            pixels, errors = [], []
            for x in batch.column(source).cast(pa.binary()).to_pylist():
                try:
                    pixels.append(None if x is None else [{"height": p.shape[0], "width": p.shape[1], "rgba": p.tobytes()} for p in images(x)])
                    errors.append("null" if x is None else None)
                except webp.WebPError as error:
                    pixels.append(None)
                    errors.append(str(error))
            yield batch.select(others).append_column("pixels", pa.array(pixels, images_type)).append_column("error", pa.array(errors, pa.string()))
        C.release_memory()

    C.bound_batches(df.sparkSession)
    given = df.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{column}`").alias(source))
    schema = given.drop(source).withColumn("pixels", F.lit(None).cast("array<struct<height:int,width:int,rgba:binary>>")).withColumn("error", F.lit(None).cast("string")).schema
    return given.mapInArrow(run, schema)


def round_trip(data: bytes) -> tuple:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; the payload's figures come from the stored bytes, read back."""
    media = store(padded(data))
    parts = list(images(media))
    back = b"".join(np.ascontiguousarray(p[..., :3]).tobytes() for p in parts)
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(parts)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, stored as WebP, read back and described; no shuffle."""
    kinds = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            columns = list(zip(*map(round_trip, C.as_bytes(batch.column("text"))), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])
        C.release_memory()

    return C.texts(C.table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
