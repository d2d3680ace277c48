"""Media columns: GIFs as rows of timed frames with colour histograms, and texts stored in GIFs.

``frames`` decodes a binary column. ``store_texts`` writes each text's bytes
as the pixels of an animation of 64 columns, in frames of up to FRAME_ROWS
rows, with a palette that names each byte by a colour of its own. Media are
written as a Parquet table in the shared folder and read again. Rows never
meet: no shuffle, and a task holds a few rows at a time.

Defined results: null or empty text: one row of 64 zero bytes; null media has
no frames; broken media give one frame row with ``error``; repeated rows are
rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import gif
from tessera.llm.common import fields, map_arrow, raw, stage_table, table

#: Production parameters.
COLUMNS, FRAME_ROWS, DELAY_MS = 64, 1024, 100


def byte_palette() -> np.ndarray:
    """256 different colours: a byte's bits 5-7, 2-4 and 0-1 as red, green and blue."""
    b = np.arange(256)
    return np.stack([(b >> 5) * 36, (b >> 2 & 7) * 36, (b & 3) * 85], axis=1).astype(np.uint8)


def payload_gif(data: bytes) -> bytes:
    """data, of a positive multiple of COLUMNS bytes, as an animation."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, COLUMNS)
    colours = byte_palette()
    frames = [gif.Frame(0, 0, pixels[k : k + FRAME_ROWS], colours, DELAY_MS, 2) for k in range(0, len(pixels), FRAME_ROWS)]
    return gif.encode(gif.Gif(COLUMNS, min(len(pixels), FRAME_ROWS), 0, 0, frames))


def payload_of(image: gif.Gif) -> bytes:
    return b"".join(f.pixels.tobytes() for f in image.frames)


def features(image: gif.Gif) -> tuple[list[dict], str]:
    """Frame rows, and all frames' share of each colour bin in 1/255 as hex."""
    rows, total, at = [], np.zeros(65, np.int64), 0
    for k, (screen, delay) in enumerate(gif.composite(image)):
        h = gif.histogram(screen)
        total += h
        rows.append({"frame": k, "start_ms": at, "delay_ms": delay, "width": image.width, "height": image.height, "histogram": h.tolist(), "error": None})
        at += delay
    share = total * 255 // max(int(total.sum()), 1)
    return rows, f"frames={len(rows)};ms={at};bins={bytes(share.astype(np.uint8)).hex()}"


FRAME = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("frame", "start_ms", "delay_ms", "width", "height")] + [T.StructField("histogram", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())]
)


def frames(media: DataFrame, *, key: str, column: str = "media") -> DataFrame:
    """One row for each frame of each GIF: the key, frame, start_ms, delay_ms, width, height, histogram (64 colour bins and transparent), error."""
    schema = T.StructType([media.schema[key], *FRAME.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    rows, _ = features(gif.decode(data.as_py()))
                except (ValueError, IndexError) as e:
                    rows = [{"error": str(e)}]
                yield pa.RecordBatch.from_pylist([{key: k, **r} for r in rows], schema=arrow)

    return map_arrow(media.select(key, column), run, schema)


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: written and read again."""
    schema = fields("doc_id bigint, n_bytes bigint, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = [t or b"" for t in raw(part.column(1))]
                media = [payload_gif(t.ljust(max(1, -(-len(t) // COLUMNS)) * COLUMNS, b"\0")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return stage_table(map_arrow(documents.select(F.col("doc_id").cast("bigint"), "text"), run, schema), "media")


def payload_digests(media: DataFrame) -> DataFrame:
    """What the stored media hold: payload sizes and digests, the media's own, and the feature string."""
    schema = fields("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = gif.decode(data)
                p = payload_of(image)
                rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-COLUMNS:]), len(data), hashlib.sha256(data).hexdigest(), features(image)[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

    return map_arrow(media, run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return payload_digests(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
