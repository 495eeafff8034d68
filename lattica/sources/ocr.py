"""Texts in images. The recogniser is passed in: a maker is called once a worker, as models are slow to load."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.images import to_array

#: An image → (polygon of four points, text, confidence) of each text.
Reader = Callable[[np.ndarray], list[tuple[list[tuple[float, float]], str, float]]]

_readers: dict[tuple, Reader] = {}


def reader(make: Callable[[list[str]], Reader], languages: tuple[str, ...] = ("en",)) -> Reader:
    """The worker's recogniser. The first call's languages hold: a model that is loaded isn't loaded again."""
    name = (make.__module__, make.__qualname__)
    if name not in _readers:
        _readers[name] = make(list(languages))
    return _readers[name]


def stub(languages: list[str]) -> Reader:
    """A recogniser for tests: it finds one text, which says how large the image is, in its upper left quarter."""
    return lambda img: [([(0.0, 0.0), (img.shape[1] / 2, 0.0), (img.shape[1] / 2, img.shape[0] / 2), (0.0, img.shape[0] / 2)],
                         f"{img.shape[1]}x{img.shape[0]}", 0.98764)]


def polygon_box(points: Column) -> dict[str, Column]:
    """x, y, width and height of the box around points (structs x, y), each cut to integers first."""
    side = lambda c: F.transform(points, lambda p: p[c].cast("long"))
    x, y = side("x"), side("y")
    return {"x": F.array_min(x), "y": F.array_min(y), "width": F.array_max(x) - F.array_min(x), "height": F.array_max(y) - F.array_min(y)}


def texts(raw: DataFrame) -> DataFrame:
    """raw (image_id, ord, polygon, text, confidence) with a box instead of the polygon, and the confidence to four places."""
    return raw.select("image_id", "ord", "text", *[c.alias(k) for k, c in polygon_box(F.col("polygon")).items()], F.bround("confidence", 4).alias("confidence"))


def read_texts(images: DataFrame, make: Callable[[list[str]], Reader] = stub, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """Texts of images (image_id, height, width, channels, data), in the recogniser's order; images that can't be read have none."""
    rows = images.where("height > 0").select(F.col("image_id").cast("string"), "height", "width", "channels", "data")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(make, languages)
        for batch in batches:
            out = [{"image_id": r["image_id"], "ord": k, "polygon": [{"x": float(x), "y": float(y)} for x, y in polygon], "text": text, "confidence": float(sure)}
                   for r in batch.to_pylist() for k, (polygon, text, sure) in enumerate(own(to_array(r["height"], r["width"], r["channels"], r["data"])))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("image_id", pa.string()), ("ord", pa.int64()), ("polygon", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
                ("text", pa.string()), ("confidence", pa.float64())]))

    return texts(rows.mapInArrow(fn, "image_id string, ord long, polygon array<struct<x:double,y:double>>, text string, confidence double"))
