"""Proximity joins and connected components.

Proximity is found by buckets: a point is put into the cells within reach, and cells are joined by equality, so no plan
compares all pairs of an image. Components of one image are found in one grouped call; a graph across images would take
the iteration of stars in tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import exprs


def endpoint_edges(segments: DataFrame, reach: int = 15, once: bool = True) -> DataFrame:
    """image_id, a, b (a < b): segments with two end points nearer than ``reach``; without ``once``, a pair may come once for each two such points.

    A point meets the points of its own cell and of the four cells that follow; the other four meet it."""
    ends = segments.select("image_id", "ord", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    ends = ends.select("image_id", "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.floor(F.col("p.x") / reach).alias("cx"), F.floor(F.col("p.y") / reach).alias("cy"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    a = ends.select("image_id", F.col("ord").alias("oa"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", ahead.alias("d"))
    a = a.select("image_id", "oa", "ax", "ay", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("same"))
    b = ends.select("image_id", F.col("ord").alias("ob"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    other = F.when(F.col("same"), F.col("oa") < F.col("ob")).otherwise(F.col("oa") != F.col("ob"))
    met = a.join(b, ["image_id", "cx", "cy"]).where(other & (dx * dx + dy * dy < reach * reach)).select("image_id", F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))
    return met.distinct() if once else met


def box_edges(boxes: DataFrame, reach: int, condition: Column, cell: int = 64, extra: list[Column] | None = None) -> DataFrame:
    """image_id, a, b (a < b): boxes l and r that a cell of ``cell`` pixels brings together and ``condition`` accepts."""
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    box = F.struct("ord", "x", "y", "width", "height")

    def covered(grow: int) -> DataFrame:
        at = boxes.select("image_id", box.alias("box"), F.explode(span(F.col("x") - grow, F.col("x") + F.col("width") + grow)).alias("cx"),
                          (F.col("y") - grow).alias("lo"), (F.col("y") + F.col("height") + grow).alias("hi"))
        return at.select("image_id", "box", "cx", F.explode(span(F.col("lo"), F.col("hi"))).alias("cy"))

    left, right = covered(reach).withColumnRenamed("box", "l"), covered(0).withColumnRenamed("box", "r")
    pairs = left.join(right, ["image_id", "cx", "cy"]).where((F.col("l.ord") < F.col("r.ord")) & condition)
    return pairs.select("image_id", F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), *(extra or [])).distinct()


def text_edges(texts: DataFrame, reach: int = 30) -> DataFrame:
    return box_edges(texts, reach, exprs.box_gap2("l", "r") < reach * reach)


def iou_edges(rects: DataFrame, threshold: float = 0.5) -> DataFrame:
    return box_edges(rects, 0, exprs.iou("l", "r") > threshold, 256, [F.bround(exprs.iou("l", "r"), 6).alias("iou")])


def image_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, ord, root (the least member): components within each image, which bounds a group."""
    rows = nodes.select("image_id", F.col("ord").alias("a"), F.col("ord").alias("b")).union(edges.select("image_id", "a", "b"))

    def fn(key, pdf):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        own = sorted(up)
        return pd.DataFrame({"image_id": key[0], "ord": own, "root": [root(x) for x in own]})

    return rows.groupBy("image_id").applyInPandas(fn, "image_id long, ord long, root long")


def merge_boxes(boxes: list[tuple[int, int, int, int]], threshold: float = 0.5) -> list[tuple[int, int, int, int]]:
    """Merge boxes in order: the one in hand grows as it meets others, and passes repeat until nothing meets."""
    while True:
        left, out = list(boxes), []
        while left:
            x, y, w, h = left.pop(0)
            rest = []
            for bx, by, bw, bh in left:
                both = max(0, min(x + w, bx + bw) - max(x, bx)) * max(0, min(y + h, by + bh) - max(y, by))
                union = w * h + bw * bh - both
                if union > 0 and both / union > threshold:
                    right, low = max(x + w, bx + bw), max(y + h, by + bh)
                    x, y = min(x, bx), min(y, by)
                    w, h = right - x, low - y
                else:
                    rest.append((bx, by, bw, bh))
            out.append((x, y, w, h))
            left = rest
        if len(out) == len(boxes):
            return out
        boxes = out


def merged_zones(rects: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, ord, x, y, w, h of merged boxes, by (y, x). The order of merging matters, so an image is one group."""

    def fn(key, pdf):
        rows = pdf.sort_values("ord")[["x", "y", "width", "height"]].itertuples(index=False, name=None)
        out = sorted(merge_boxes(list(rows), threshold), key=lambda b: (b[1], b[0]))
        return pd.DataFrame([(key[0], k, *b) for k, b in enumerate(out)], columns=["image_id", "ord", "x", "y", "w", "h"])

    return rects.select("image_id", "ord", "x", "y", "width", "height").groupBy("image_id").applyInPandas(fn, "image_id long, ord long, x long, y long, w long, h long")
