"""Media columns: progressive JPEG files in a binary column, to coefficients and full-resolution RGB tensors.

`store_payloads` writes bytes as quantised coefficients (the format's unit), a block of 64 for 64 bytes;
`decode_media` turns any progressive or baseline file into a tensor column; `read_payloads` reads bytes back
from the accumulated coefficients and describes the tensor. Tasks work on a bounded number of bytes at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import by_bytes, small_batches, text_bytes

_SLICE = 3 << 20
#: Columns of MCUs in a payload image; taller images than the format allows get more.
_TALL = 4095


def payload_images(payloads: list[np.ndarray], restart: int = 8) -> list[bytes]:
    """4:2:0 files whose coefficients hold payloads (multiples of 64 bytes).

    A byte b is the coefficient b, or b - 255 below 128: magnitudes of 128 to 255. Blocks fill luma row by row,
    then both chroma planes; blocks that are left stay zero, which no byte is.
    """
    shapes = []
    for p in payloads:
        mcus = -(-len(p) // 384)
        across = -(-mcus // _TALL)
        shapes.append((across, -(-mcus // across), len(p) // 64))
    blocks = np.concatenate(payloads).reshape(-1, 64).astype(np.int16)
    return jpeg.encode_dense(shapes, np.where(blocks >= 128, blocks, blocks - 255), restart)


def image_payload(coefficients: np.ndarray) -> np.ndarray:
    """The bytes that `payload_image` stored in these blocks."""
    used = coefficients[coefficients[:, 0] != 0].ravel()
    return np.where(used > 0, used, used + 255).astype(np.uint8)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as UTF-8 with zero bytes up to a positive multiple of 64, in a progressive JPEG.

    Null counts as empty; ids may be null or repeat. Extra columns don't go on. An empty table gives no rows. A text of
    any length is one row and one file, so a task holds several times its longest text.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _SLICE):
            raw, offsets = text_bytes(batch.column("text"))
            payloads = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payloads.append(np.zeros(max(64, -(-(b - a) // 64) * 64), np.uint8))
                payloads[-1][: b - a] = raw[a:b]
            files = payload_images(payloads)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_some(files: list[bytes | None]) -> tuple[list[jpeg.Image | None], np.ndarray, list[str | None]]:
    """(images, coefficients, reasons) of a slice: where a file is null, cut off or no JPEG the image is None and the reason says so.

    All files are decoded side by side; only if that fails is each looked at alone, and the sound ones are decoded again.
    """
    # Without its end a file would be read on into the next one.
    reasons: list[str | None] = ["null" if f is None else None if f.rstrip(b"\0").endswith(b"\xff\xd9") else "no end of image" for f in files]

    def sound() -> list[int]:
        return [k for k, why in enumerate(reasons) if why is None]

    def decode(some: list[int]) -> tuple[list[jpeg.Image], np.ndarray]:
        return jpeg.decode_coefficients([files[k] for k in some]) if some else ([], np.zeros((0, 64), np.int16))

    try:
        found, coefficients = decode(sound())
    except _BROKEN:
        for k in sound():
            try:
                decode([k])
            except _BROKEN as error:
                reasons[k] = f"{type(error).__name__}: {error}"[:200]
        found, coefficients = decode(sound())
    images: list[jpeg.Image | None] = [None] * len(files)
    for k, image in zip(sound(), found, strict=True):
        images[k] = image if image.components and image.scans else None
        reasons[k] = None if images[k] else "no frame or no scan"
    return images, coefficients, reasons


#: What broken files make the decoder raise.
_BROKEN = (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, height, width, rgb, reason): full-resolution tensors, height x width x 3 bytes, row by row. Null, empty and broken files give null values and
    the reason, which is null for sound ones; they don't touch others."""
    small_batches(media.sparkSession)
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", _SLICE):
            images, coefficients, reasons = decode_some(batch.column("media").to_pylist())
            rows = [None if i is None else jpeg.samples(i, coefficients) for i in images]
            sizes = [pa.array([None if t is None else t.shape[k] for t in rows], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *sizes, pa.array([None if t is None else t.tobytes() for t in rows], pa.binary()), pa.array(reasons, pa.string())], ["id", "height", "width", "rgb", "reason"])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, height int, width int, rgb binary, reason string").withColumnRenamed("id", id_col)


def describe(tensor: np.ndarray) -> str:
    """Size, sums of the three channels and of the green channel's steps to the right: whole numbers, so equal tensors give equal strings."""
    r, g, b = (int(tensor[..., k].sum(dtype=np.int64)) for k in range(3))
    green = tensor[..., 1].astype(np.int16)
    return f"{tensor.shape[1]}x{tensor.shape[0]};r={r};g={g};b={b};dx={int(np.abs(np.diff(green, axis=1)).sum(dtype=np.int64))}"


def read_payloads(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the stored files of `store_payloads`. A file that is null or broken gives nulls behind n_bytes, but for its own size and digest."""
    small_batches(media.sparkSession)
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", _SLICE):
            files = batch.column("media").to_pylist()
            images, coefficients, _ = decode_some(files)
            rows = []
            for file, image in zip(files, images, strict=True):
                stored = (None, None) if file is None else (len(file), hashlib.sha256(file).hexdigest())
                if image is None:
                    rows.append((None, None, None, *stored, None))
                    continue
                last = image.components[-1]
                payload = image_payload(coefficients[image.components[0].base : last.base + last.wide * last.high]).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, describe(jpeg.samples(image, coefficients))))
            sizes, digests, tails, lengths, marks, features = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(tails, pa.int64()), pa.array(lengths, pa.int64()), pa.array(marks, pa.string()), pa.array(features, pa.string())],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
