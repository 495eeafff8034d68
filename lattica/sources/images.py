"""Images as rows: Spark's image source, arrays of its rows, tiles, and PNG bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, drop_unreadable: bool = False) -> DataFrame:
    """origin, height, width, channels, data (rows of blue, green, red bytes). Unreadable files have a height of -1, or are dropped."""
    return spark.read.format("image").option("dropInvalid", str(drop_unreadable).lower()).load(path).select(
        "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """H × W × 3; one channel is repeated and a fourth one dropped."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(img, 3, axis=2) if channels == 1 else img[:, :, :3]


def png(img: np.ndarray) -> bytes:
    """A PNG file of a gray or blue-green-red array."""
    if img.ndim not in (2, 3) or not img.size:
        raise ValueError("an image needs pixels")
    rows = img if img.ndim == 2 else img[:, :, ::-1]
    h, w = rows.shape[:2]
    raw = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
