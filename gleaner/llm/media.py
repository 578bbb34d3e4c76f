"""A media column of lossless WebP images: texts' bytes as grey pixels, and what is read back from them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import webp, webp_grey
from gleaner.llm.common import as_bytes, in_blocks, tidy, whole_text

BLOCK = webp_grey.WIDTH


def _encode_batches(batches):
    for batch in in_blocks(batches):
        texts = as_bytes(batch.column(1))
        media = webp_grey.encode_many([t + bytes(-len(t) % BLOCK or (0 if t else BLOCK)) for t in texts])
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of every whole text, zeros up to a positive multiple of 64, as a grey image.

    A null text is empty.  Repeated rows and null ids keep their rows; other columns are not read.  A text of any size
    has one file, in frames of bounded size.
    """
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(tidy(_encode_batches), "doc_id bigint, n_bytes bigint, media binary")


def feature(pixels: np.ndarray) -> str:
    """Size, mean sample in thousandths and the shares of 16 ranges of samples in thousandths."""
    histogram, (h, w) = np.bincount(pixels.ravel(), minlength=256), pixels.shape
    shares = histogram.reshape(16, 16).sum(axis=1) * 1000 // pixels.size
    return f"{w}x{h};{int((histogram * np.arange(256)).sum()) * 1000 // pixels.size};" + ",".join(map(str, shares.tolist()))


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _decode_batches(batches):
    for batch in in_blocks(batches, 2):
        rows, files = [], batch.column(2).to_pylist()
        for file, pixels in zip(files, webp_grey.decode_many(files), strict=True):
            payload = pixels.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature(pixels)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in _FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """Decode a media column and describe the payload read back; equal texts have equal values."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_decode_batches), _FEATURES)


def pixel_arrays(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with (height, width, samples) of their images, samples as RGBA bytes; a null has none."""

    @F.arrow_udf("struct<height: int, width: int, samples: binary>")
    def pixels(files: pa.Array) -> pa.Array:
        found = [None if f is None else webp.decode(f) for f in files.to_pylist()]
        return pa.array([None if p is None else {"height": p.shape[0], "width": p.shape[1], "samples": p.tobytes()} for p in found], pa.struct([("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary())]))

    return media.withColumn("pixels", pixels(F.col(column)))
