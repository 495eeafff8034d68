"""Whole images in Arrow batches: one exchange by image, and one call for as many images as a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_image(df: DataFrame, order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn over tables of whole images, sorted by image_id and ``order``. A task holds one batch and the image that goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            # the last image of a batch may go on
            cut = int(np.searchsorted(ids, ids[-1]))
            if not cut and held and held[-1].column(0)[-1].as_py() == ids[0]:
                held.append(batch)
                continue
            if cut:
                held.append(batch.slice(0, cut))
            if held:
                yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()
            held = [batch.slice(cut)]
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    rest = [c for c in df.columns if c != "image_id"]
    rows = df.where("image_id is not null").select("image_id", *rest)
    return rows.repartition("image_id").sortWithinPartitions("image_id", *order).mapInArrow(run, schema)


class Grid:
    """Finds pixels of sorted (image, y, x) by their place."""

    def __init__(self, image: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.ids = np.unique(image)
        self.y0, self.x0 = (int(v.min()) if len(v) else 0 for v in (y, x))
        self.height, self.width = (int(v.max()) - v0 + 1 if len(v) else 0 for v, v0 in ((y, self.y0), (x, self.x0)))
        self.key = self._key(np.searchsorted(self.ids, image), y, x)

    def _key(self, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (image * self.height + y - self.y0) * self.width + x - self.x0

    def find(self, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is such a pixel, and its row."""
        if not len(self.key):
            return np.zeros(y.shape, bool), np.zeros(y.shape, np.int64)
        at = np.minimum(np.searchsorted(self.ids, image), len(self.ids) - 1)
        inside = (self.ids[at] == image) & (y >= self.y0) & (y < self.y0 + self.height) & (x >= self.x0) & (x < self.x0 + self.width)
        key = self._key(at, y, x)
        row = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return inside & (self.key[row] == key), row
