"""Operators over pixels in long form (image_id, y, x, b, g, r), for images small enough to be rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.images import Grid, by_image

#: Hue ranges (hue 0-179, saturation and value 0-255) by label.
HSV_RANGES = [("red_low", 0, 10), ("red_high", 170, 179), ("orange", 11, 25), ("yellow", 26, 35), ("green", 36, 85), ("cyan", 86, 100), ("blue", 101, 130), ("purple", 131, 160), ("magenta", 161, 169)]
LEAST_S, LEAST_V = 70, 50
CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))


def gray() -> Column:
    """Luma with weights of 0.299, 0.587 and 0.114 in 14 fixed bits."""
    return F.expr("(r*4899 + g*9617 + b*1868 + 8192) div 16384")


def otsu(pixels: DataFrame) -> DataFrame:
    """image_id, threshold: the lowest gray level of the largest variance between what is up to it and what is above."""
    hist = pixels.groupBy("image_id", gray().alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w, all_rows = Window.partitionBy("image_id").orderBy("level"), Window.partitionBy("image_id")
    s = F.col("level") * F.col("n")
    sums = hist.select("image_id", "level", F.sum("n").over(w).alias("w0"), F.sum(s).over(w).alias("s0"), F.sum("n").over(all_rows).alias("nn"), F.sum(s).over(all_rows).alias("ss"))
    gap = (F.col("ss") * F.col("w0") - F.col("nn") * F.col("s0")).cast("double")
    between = F.when(F.col("w0") < F.col("nn"), gap * gap / (F.col("w0") * (F.col("nn") - F.col("w0"))).cast("double")).otherwise(0.0)
    return sums.groupBy("image_id").agg(F.min(F.struct((-between).alias("b"), "level")).alias("m")).select("image_id", F.col("m.level").alias("threshold"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _thresholds(image: np.ndarray, level: np.ndarray) -> np.ndarray:
    """As ``otsu``: the threshold of each pixel's image. Images are numbered from 0, without gaps."""
    low = int(level.min())
    span = int(level.max()) - low + 1
    key, n = np.unique(image * span + level - low, return_counts=True)
    of, at = key // span, key % span + low
    first = np.searchsorted(of, np.arange(int(of[-1]) + 1))
    last = np.append(first[1:], len(of)) - 1

    def sums(x: np.ndarray) -> np.ndarray:
        upto = np.cumsum(x)
        return upto - (upto[first] - x[first])[of]

    w0, s0 = sums(n), sums(at * n)
    nn, ss = w0[last][of], s0[last][of]
    gap = (ss * w0 - nn * s0).astype(float)
    between = np.where(w0 < nn, gap * gap / np.maximum(w0 * (nn - w0), 1).astype(float), 0.0)
    best = np.lexsort((at, -between, of))[first]
    return at[best][image]


def _dark(pixels: DataFrame, fn, schema: str) -> DataFrame:
    """fn over tables of whole images with the 0-1 column ``ink``: whether a pixel is at most its image's threshold. Threshold and neighbours take one
    exchange, and no histogram is joined to the pixels, so none has to be ready, or fit, before they are read."""

    def run(table: pa.Table) -> pa.Table:
        level = table.column("level").to_numpy()
        image = np.unique(table.column("image_id").to_numpy(), return_inverse=True)[1]
        return fn(table.drop_columns("level").append_column("ink", pa.array((level <= _thresholds(image, level)).astype(np.int32))))

    return by_image(pixels.withColumn("level", gray()), ["y", "x"], run, schema)


def line_densities(pixels: DataFrame) -> DataFrame:
    """image_id, line_density: the share of pixels that are at most their image's threshold."""

    def fn(table: pa.Table) -> pa.Table:
        return table.group_by("image_id").aggregate([("ink", "sum"), ("ink", "count")]).select(["image_id", "ink_sum", "ink_count"])

    rows = pixels.select("image_id", "y", "x", "b", "g", "r")
    sums = _dark(rows, fn, _schema(rows.select("image_id")) + ", ink_sum long, ink_count long")
    return sums.select("image_id", F.bround(F.col("ink_sum").cast("double") / F.col("ink_count"), 6).alias("line_density"))


def stencil(pixels: DataFrame, columns: list[str], *hows: str, offsets=CROSS) -> DataFrame:
    """The least (``min``) or largest (``max``) value of each pixel's neighbourhood, one step after another; neighbours outside the
    image don't count. Other columns stay."""
    first = pixels.select("image_id", *[c for c in pixels.columns if c != "image_id"])
    return by_image(first, ["y", "x"], lambda table: _spread(table, columns, hows, offsets), _schema(first))


def _spread(table: pa.Table, columns: list[str], hows: tuple[str, ...], offsets=CROSS) -> pa.Table:
    steps = [{"min": np.minimum, "max": np.maximum}[how] for how in hows]
    image, y, x = (table.column(c).to_numpy() for c in ("image_id", "y", "x"))
    grid = Grid(image, y, x)
    near = [grid.find(image, y + dy, x + dx) for dy, dx in offsets if (dy, dx) != (0, 0)]
    for c in columns:
        value = table.column(c).to_numpy()
        for step in steps:
            out = value.copy()
            for there, row in near:
                out = np.where(there, step(out, value[row]), out)
            value = out
        table = table.set_column(table.schema.get_field_index(c), c, pa.array(value, table.schema.field(c).type))
    return table


def _gained(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, b, g, r, ``ink`` and ``grown``: 1 for dark pixels, and for those and their neighbours."""

    def fn(table: pa.Table) -> pa.Table:
        return _spread(table.append_column("grown", table.column("ink")), ["grown"], ("max",))

    rows = pixels.select("image_id", "y", "x", "b", "g", "r")
    return _dark(rows, fn, _schema(rows) + ", ink int, grown int")


def gained(pixels: DataFrame) -> DataFrame:
    """image_id, y, x of pixels that dark lines gain when they grow."""
    return _gained(pixels).where("grown = 1 and ink = 0").select("image_id", "y", "x")


def enhanced(pixels: DataFrame) -> DataFrame:
    """Pixels that dark lines gain when they grow become black; the others stay."""
    new = F.expr("grown = 1 and ink = 0")
    return _gained(pixels).select("image_id", "y", "x", *[F.when(new, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("b", "g", "r")])


def closed_gray(pixels: DataFrame) -> DataFrame:
    """Gaps of dark lines closed, as lines of black on white."""

    def fn(table: pa.Table) -> pa.Table:
        return _spread(table.select(["image_id", "y", "x", "ink"]), ["ink"], ("max", "min"))

    rows = pixels.select("image_id", "y", "x", "b", "g", "r")
    return _dark(rows, fn, _schema(rows.select("image_id", "y", "x")) + ", ink int").select("image_id", "y", "x", (255 - 255 * F.col("ink")).alias("gray"))


def crops(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of each tile (image_id, row_no, col_no, x, y, width, height), at their place in the tile; where tiles overlap, a pixel is in each."""
    at = tiles.select("image_id", "row_no", "col_no", F.col("x").alias("tx"), F.col("y").alias("ty"), "width", "height")
    held = (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + F.col("width")) & (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + F.col("height"))
    return pixels.join(at, "image_id").where(held).withColumns({"x": F.col("x") - F.col("tx"), "y": F.col("y") - F.col("ty")}).drop("tx", "ty", "width", "height")


def hsv() -> dict[str, Column]:
    """Hue (0-179), saturation and value of a pixel."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    span = (top - low).cast("double")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    some = F.nullif(span, F.lit(0.0))
    hue = F.when(span == 0, 0.0).when(top == r, 30 * (g - b) / some).when(top == g, 60 + 30 * (b - r) / some).otherwise(120 + 30 * (r - g) / some)
    hue = F.rint(F.when(hue < 0, hue + 180).otherwise(hue)).cast("long") % 180
    return {"h": hue, "s": F.when(top == 0, F.lit(0)).otherwise(F.rint(255 * span / F.nullif(top, F.lit(0)))).cast("long"), "v": top}


def channels(pixels: DataFrame) -> DataFrame:
    """image_id, channel, y, x: pixels of each colour range; both ends of red are one channel, and empty channels don't appear."""
    name = F
    for label, low, high in HSV_RANGES:  # they don't overlap
        name = name.when(F.col("h").between(low, high), "red" if label.startswith("red_") else label)
    rows = pixels.withColumns(hsv()).where((F.col("s") >= LEAST_S) & (F.col("v") >= LEAST_V))
    return rows.select("image_id", name.alias("channel"), "y", "x").where("channel is not null")


def _along(lines: DataFrame, pixels: DataFrame, values: list[str], n: int, fn, schema: str) -> DataFrame:
    """fn(line rows, whether a point has a pixel (lines × n), values of its pixel) for n evenly spaced points of each line; lines and pixels of an
    image meet in one call."""
    whole = lambda *cs: [F.col(c).cast("long").alias(a) for c, a in cs]
    none = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    image = F.col("image_id").cast("long").alias("image_id")
    points = pixels.select(image, F.lit(0).alias("kind"), *whole(("y", "y"), ("x", "x")), *none("ord", "y2", "x2"), *[F.col(v).cast("long").alias(v) for v in values])
    ends = lines.select(image, F.lit(1).alias("kind"), *whole(("y1", "y"), ("x1", "x"), ("ord", "ord"), ("y2", "y2"), ("x2", "x2")), *none(*values))
    step = np.arange(n)

    def run(table: pa.Table) -> pa.Table:
        at = {c: table.column(c).to_numpy() for c in table.column_names}
        pixel, line = (np.flatnonzero(at["kind"] == k) for k in (0, 1))
        grid = Grid(*(at[c][pixel] for c in ("image_id", "y", "x")))

        def way(a: str, b: str) -> np.ndarray:
            first, last = at[a][line][:, None], at[b][line][:, None]
            num = first * (n - 1) + step * (last - first)
            return np.sign(num) * (np.abs(num) // (n - 1))

        there, row = grid.find(np.repeat(at["image_id"][line][:, None], n, 1), way("y", "y2"), way("x", "x2"))
        got = {v: np.where(there, at[v][pixel][row], 0) if len(pixel) else np.zeros(there.shape, np.int64) for v in values}
        some = there.any(axis=1)
        return fn({c: at[c][line][some] for c in ("image_id", "ord")}, there[some], {v: x[some] for v, x in got.items()})

    return by_image(points.unionByName(ends), ["kind", "y", "x"], run, schema)


def mean_colours(lines: DataFrame, pixels: DataFrame, n: int = 20) -> DataFrame:
    """The mean colour of n points of each line, cut to integers."""

    def fn(line: dict, there: np.ndarray, got: dict) -> pa.Table:
        count = there.sum(axis=1)
        return pa.table({**line, **{c: got[c].sum(axis=1) // count for c in ("r", "g", "b")}})

    return _along(lines, pixels, ["r", "g", "b"], n, fn, "image_id long, ord long, r long, g long, b long")


def dashes(lines: DataFrame, pixels: DataFrame, n: int = 40, least: int = 6) -> DataFrame:
    """How often the gray of n points changes its side of their mean; a line of at least six changes is dashed."""

    def fn(line: dict, there: np.ndarray, got: dict) -> pa.Table:
        # the sum and the count keep the comparison with the mean exact
        side = np.sign(got["gray"] * there.sum(axis=1)[:, None] - got["gray"].sum(axis=1)[:, None])
        of, at = np.nonzero(there)
        said = side[of, at]
        turn = (of[1:] == of[:-1]) & (said[1:] != said[:-1])
        changes = np.bincount(of[1:][turn], minlength=len(there)).astype(np.int64)
        return pa.table({**line, "changes": changes, "is_dashed": changes >= least})

    return _along(lines, pixels.select("image_id", "y", "x", gray().alias("gray")), ["gray"], n, fn, "image_id long, ord long, changes long, is_dashed boolean")
