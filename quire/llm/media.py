"""Media columns: texts as progressive JPEG bytes, and images as RGB tensors.

Defined results: null counts as empty text, which is stored as 192 spaces; equal texts give equal
files and features; an empty table gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import jpeg
from quire.llm._common import map_batches, slices, texts_of

UNIT = 192


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 filled up with spaces to a positive multiple of UNIT, and the length before."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel (1/16 steps, by integers) and the signs of the brightness steps
    between 16 columns of the image."""
    h, w, _ = rgb.shape
    mean = 16 * rgb.sum(axis=(0, 1), dtype=np.int64) // (h * w)
    edge = np.linspace(0, w, 17).astype(int)
    cells = np.add.reduceat(rgb.sum(axis=(0, 2), dtype=np.int64), edge[:-1]) // np.maximum(np.diff(edge), 1)
    return f"{w}x{h} {' '.join(map(str, mean.tolist()))} {int(np.packbits(np.diff(cells) > 0).astype(int) @ (256, 1)):04x}"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                body, n = payload(text)
                stored = jpeg.write_bytes(body)
                image = jpeg.read(stored)
                back = jpeg.payload_of(image, len(body))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image.rgb())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id and the stored file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([jpeg.write_bytes(payload(t)[0]) for t in texts_of(batch)], pa.binary())], names=["doc_id", "jpeg"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, jpeg binary")


def rgb_tensors(images: DataFrame, key: str = "doc_id", column: str = "jpeg") -> DataFrame:
    """key, height, width, rgb (row-major bytes, three for each place) of a column of progressive
    JPEG files; bytes that are null or can't be read give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            rows = []
            for data in batch.column(column).to_pylist():
                try:
                    rgb = jpeg.read(data).rgb() if data else None
                except (ValueError, IndexError, KeyError):
                    rgb = None
                rows.append((None, None, None) if rgb is None else (*rgb.shape[:2], rgb.tobytes()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *cols], names=[key, "height", "width", "rgb"])

    return map_batches(images.select(key, column), run, f"`{key}` {images.schema[key].dataType.simpleString()}, height int, width int, rgb binary")
