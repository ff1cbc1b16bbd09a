"""Hashes and thumbnails from the pixels of images, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.session import bound_batches

#: Side of the shrunk image and of the block of low frequencies, least side of an image that is hashed,
#: weights of red, green and blue, mean deviation that an image with something on it exceeds.
SIDE, BLOCK, MIN_SIDE, LUMA, MIN_DEVIATION = 32, 8, 48, (0.299, 0.587, 0.114), 6


@lru_cache(64)
def boxes(size: int, n: int) -> np.ndarray:
    """The n x size matrix that averages `size` pixels into `n` boxes, of one pixel at least."""
    at = np.arange(n + 1) * size // n
    first, end = at[:-1], np.maximum(at[:-1] + 1, at[1:])
    pixel = np.arange(size)
    inside = (pixel >= first[:, None]) & (pixel < end[:, None])
    return inside / inside.sum(1, keepdims=True)


def _waves() -> np.ndarray:
    """The BLOCK lowest cosine waves over SIDE points."""
    return np.cos(np.outer(np.arange(BLOCK), 2 * np.arange(SIDE) + 1) * np.pi / (2 * SIDE))


@lru_cache(64)
def _low_waves(size: int) -> np.ndarray:
    """The waves over the SIDE boxes of `size` pixels."""
    return _waves() @ boxes(size, SIDE)


def _grid(pixels: bytes | None, width: int | None, height: int | None, channels: int | None) -> np.ndarray | None:
    """height x width x channels; None where a part is missing or the sizes do not fit."""
    if not pixels or not width or not height or channels not in (1, 3, 4) or len(pixels) != width * height * channels:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)


def image_hash(pixels: bytes | None, width: int | None, height: int | None, channels: int | None) -> int | None:
    """64 bits, the first one highest: which of the 63 low frequencies but the mean exceed their median; the last is 0.

    Shrinking and transform are linear, so each side of the image meets one small matrix. Transparency counts for nothing.
    """
    g = _grid(pixels, width, height, channels)
    if g is None or min(width, height) < MIN_SIDE:
        return None
    gray = g[:, :, 0] if channels == 1 else g[:, :, :3] @ np.array(LUMA)
    low = (_low_waves(height) @ gray @ _low_waves(width).T).reshape(-1)[1:]
    bits = np.append(low > np.sort(low)[len(low) // 2], False)
    return int(np.packbits(bits).view(">i8")[0])


def thumbnail(pixels: bytes | None, width: int | None, height: int | None, channels: int | None, to: tuple[int, int]) -> bytes | None:
    """Red, green and blue of the image in boxes of `to` (width, height), halves rounded up, on white."""
    g = _grid(pixels, width, height, channels)
    if g is None:
        return None
    rgb = np.repeat(g, 3, axis=2) if channels == 1 else g[:, :, :3]
    if channels == 4:
        alpha = g[:, :, 3:] / 255
        rgb = rgb * alpha + 255 * (1 - alpha)
    small = np.einsum("yh,hwc,xw->yxc", boxes(height, to[1]), rgb, boxes(width, to[0]), optimize=True)
    # The matrix products leave noise far below the least distance of a mean from a half.
    return np.floor(np.round(small, 6) + 0.5).astype(np.uint8).tobytes()


def deviation(rgb: bytes) -> float:
    """Mean distance of the brightness from its mean."""
    gray = np.frombuffer(rgb, np.uint8).reshape(-1, 3).mean(1)
    return float(np.abs(gray - gray.mean()).mean())


def describe(images: DataFrame, to: tuple[int, int]) -> DataFrame:
    """image_id, hash, thumb, says_something per row of `images` (image_id, width, height, channels, pixels; others go).

    hash: null under 48 pixels a side. thumb: RGB bytes of `to` (width, height); says_something: it is not nearly of one
    colour. All three are null where the pixels are missing or do not fill the stated size. An image never leaves its task.
    """

    bound_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height", "channels")), strict=True))
            thumbs = [thumbnail(*r, to) for r in rows]
            says = [None if t is None else deviation(t) > MIN_DEVIATION for t in thumbs]
            hashes = pa.array([image_hash(*r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), hashes, pa.array(thumbs, pa.binary()), pa.array(says, pa.bool_())], names=["image_id", "hash", "thumb", "says_something"])

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "width", "height", "channels", "pixels").mapInArrow(run, f"image_id {kind}, hash long, thumb binary, says_something boolean")


def hashes(images: DataFrame) -> DataFrame:
    """image_id, hash as in `describe`, which makes thumbnails as well."""
    bound_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "height", "channels")), strict=True)
            found = pa.array([image_hash(*r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), found], names=["image_id", "hash"])

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "width", "height", "channels", "pixels").mapInArrow(run, f"image_id {kind}, hash long")
