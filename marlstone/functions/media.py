"""Features of images and audio files."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions that make a literal a picture or a sound.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tif", ".tiff", ".webp")
AUDIO_EXTENSIONS = (".mp3", ".wav", ".flac", ".ogg")

SIDE, BINS, AUDIO_DIMS = 64, 256, 32


def media_kind(path: str) -> str:
    low = path.lower()
    return "image" if low.endswith(IMAGE_EXTENSIONS) else "audio" if low.endswith(AUDIO_EXTENSIONS) else "text"


def gray_histogram(pixels: np.ndarray) -> list[float]:
    """Shares of the 256 gray levels in a picture (height, width, channels as blue, green, red) scaled to 64 x 64 by area means."""
    p = pixels.astype(np.float64)
    if p.ndim == 2:
        p = p[:, :, None]
    gray = p[:, :, 0] if p.shape[2] < 3 else 0.114 * p[:, :, 0] + 0.587 * p[:, :, 1] + 0.299 * p[:, :, 2]

    def shrink(a: np.ndarray) -> np.ndarray:
        """The first axis to SIDE cells, each the mean of the part of the axis that it covers."""
        sums = np.concatenate((np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)))
        at = np.linspace(0, a.shape[0], SIDE + 1)
        low = np.minimum(np.floor(at).astype(int), a.shape[0] - 1)
        value = sums[low] + a[low] * (at - low)[:, None]
        return np.diff(value, axis=0) / np.diff(at)[:, None]

    small = shrink(shrink(gray).T).T
    levels = np.clip(np.rint(small), 0, BINS - 1).astype(int)
    h = np.bincount(levels.ravel(), minlength=BINS)
    return (h / h.sum()).tolist()


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def image_histogram(image: pa.Array) -> pa.Array:
    """From Spark's image column; null for pictures that can't be read."""
    out = []
    for x in image.to_pylist():
        ok = x and x["nChannels"] and x["data"] and x["height"] > 0 and x["width"] > 0
        out.append(gray_histogram(np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"])) if ok else None)
    return pa.array(out, pa.list_(pa.float64()))


def path_vector(path: str) -> list[float]:
    """A vector that depends on the first eight bytes of a file's name only."""
    seed = int.from_bytes(os.path.basename(path).encode()[:8], "little")
    return np.abs(np.random.default_rng(seed).standard_normal(AUDIO_DIMS)).tolist()


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def path_vectors(path: pa.Array) -> pa.Array:
    return pa.array([None if x is None else path_vector(x) for x in path.to_pylist()], pa.list_(pa.float64()))
