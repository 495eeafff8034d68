"""Calibration, grids and tiles, as columns of one row for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs


def _steps(value: Column, *steps: tuple[float, int], otherwise: int) -> Column:
    out = F
    for limit, result in steps:
        out = out.when(value > limit, result)
    return out.otherwise(otherwise)


def preprocess_params(images: DataFrame) -> DataFrame:
    """Parameters that follow from an image's line thickness, densities and contrast."""
    t = F.col("thickness")
    return images.select(
        "image_id", F.when(t >= 3, 1).otherwise(2).alias("upscale_factor"), F.lit(3).alias("morph_kernel_size"),
        F.when(t >= 4, 0).when(t >= 2, 1).otherwise(2).alias("morph_iterations"),
        F.when((t < 2) | (F.col("line_density") < 0.03), 3).otherwise(0).alias("close_gaps_kernel"),
        (F.col("contrast") < 50).alias("clahe_enabled"), F.lit(2.0).alias("clahe_clip_limit"), F.lit(8).alias("clahe_grid_size"), F.lit(True).alias("sharpen_enabled"),
        F.when(F.col("text_density") > 0.05, 1.0).otherwise(1.5).alias("sharpen_amount"), _steps(F.col("line_density"), (0.15, 16), (0.08, 12), (0.03, 8), otherwise=4).alias("tile_count"))


def tiling_params(images: DataFrame) -> DataFrame:
    """Rows, columns and overlap: denser images get more tiles, dealt out by the aspect."""
    target = _steps(F.col("line_density") + F.col("text_density"), (0.20, 16), (0.10, 12), (0.04, 8), otherwise=4)
    rows = images.withColumn("target", target).withColumn("wide", F.col("w") >= F.col("h"))
    skew = F.sqrt(F.col("w") / F.col("h"))
    major = F.greatest(F.lit(1), exprs.half_even(F.when(F.col("wide"), F.sqrt("target") * skew).otherwise(F.sqrt("target") / skew)))
    rows = rows.withColumn("major", major).withColumn("minor", F.greatest(F.lit(1), exprs.half_even(F.col("target") / F.col("major"))))
    more = sum((F.when(c, 0.05).otherwise(0.0) for c in (F.col("text_density") > 0.05, F.col("thickness") < 2, F.col("colors") > 6)), F.lit(0.20))
    side = lambda a, b: F.greatest(F.lit(2).cast("long"), F.when(F.col("wide"), F.col(a)).otherwise(F.col(b)))
    return rows.select("image_id", side("minor", "major").alias("rows"), side("major", "minor").alias("cols"), F.bround(F.least(more, F.lit(0.40)), 2).alias("overlap"))


def grid_size(images: DataFrame, target: int = 1024, overlap: float = 0.25, most: int = 16) -> DataFrame:
    """rows and cols of tiles of about ``target`` pixels. A grid of more than ``most`` tiles keeps its aspect: its rows come
    from the root of the budget over the aspect; the larger side shrinks until the budget holds, then both sides grow as it allows."""
    shared = round(target * overlap)
    count = lambda side: F.greatest(F.lit(1), F.ceil((F.col(side) - shared) / float(target - shared))).cast("long")
    free = images.withColumn("free_rows", count("h")).withColumn("free_cols", count("w"))
    ratio = F.col("free_cols") / F.col("free_rows")
    first = F.greatest(F.lit(1).cast("long"), exprs.half_even(F.sqrt(most / ratio)))
    start = F.struct(first.alias("r"), F.greatest(F.lit(1).cast("long"), exprs.half_even(first * ratio)).alias("c"))
    one = F.lit(1).cast("long")
    # each step takes one from the larger side; so many steps always suffice
    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(4 * most)), start, lambda s, _: F.when(s["r"] * s["c"] <= most, s).when(
        s["r"] >= s["c"], F.struct(F.greatest(one, s["r"] - 1).alias("r"), s["c"].alias("c"))).otherwise(F.struct(s["r"].alias("r"), F.greatest(one, s["c"] - 1).alias("c"))))
    capped = free.withColumn("s", shrunk).withColumn("r", F.greatest("s.r", F.floor(most / F.col("s.c")))).withColumn("c", F.greatest("s.c", F.floor(most / F.col("r"))))
    over = F.col("free_rows") * F.col("free_cols") > most
    pick = lambda cut, free, name: F.when(over, F.col(cut)).otherwise(F.col(free)).alias(name)
    return capped.select("image_id", "free_rows", "free_cols", pick("r", "free_rows", "rows"), pick("c", "free_cols", "cols"))


def tiles(images: DataFrame, overlap: float) -> DataFrame:
    """One row for each tile of an image of w × h pixels in rows × cols, in row-major order."""
    down = images.select("image_id", "w", "cols", F.inline(exprs.axis_positions(F.col("h"), F.col("rows"), overlap)).alias("row_no", "y", "height"))
    both = down.select("image_id", "cols", "row_no", "y", "height", F.inline(exprs.axis_positions(F.col("w"), F.col("cols"), overlap)).alias("col_no", "x", "width"))
    return both.select("image_id", "row_no", "col_no", (F.col("row_no") * F.col("cols") + F.col("col_no")).alias("ord"), "x", "y", "width", "height")


def _with_next(axis: Column) -> Column:
    """Each position of an axis with the one after it, null after the last."""
    return F.transform(axis, lambda p, k: F.struct(p.alias("own"), F.get(axis, k + 1).alias("next")))


def adjacent(images: DataFrame, overlap: float) -> DataFrame:
    """Tiles of an image of w × h pixels in rows × cols with their right and lower neighbours, and the rectangle that both cover. All follows from the axes of one row."""
    down = images.withColumn("across", _with_next(exprs.axis_positions(F.col("w"), F.col("cols"), overlap)))
    down = down.select("image_id", "across", F.explode(_with_next(exprs.axis_positions(F.col("h"), F.col("rows"), overlap))).alias("v"))
    cells = down.select("image_id", "v", F.explode("across").alias("u"))
    pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    near = F.filter(F.array(pair("v.own", "u.next"), pair("v.next", "u.own")), lambda p: p["v"].isNotNull() & p["u"].isNotNull())
    both = cells.select("image_id", F.col("v.own").alias("va"), F.col("u.own").alias("ua"), F.explode(near).alias("b"))
    both = both.select("image_id", "va", "ua", F.col("b.v").alias("vb"), F.col("b.u").alias("ub"))
    start = lambda a: F.greatest(F.col(f"{a}a.origin"), F.col(f"{a}b.origin"))
    end = lambda a: F.least(*[F.col(f"{a}{k}.origin") + F.col(f"{a}{k}.size") for k in "ab"])
    zero = F.lit(0).cast("long")
    return both.select("image_id", F.col("va.i").alias("row_a"), F.col("ua.i").alias("col_a"), F.col("vb.i").alias("row_b"), F.col("ub.i").alias("col_b"),
                       start("u").alias("x"), start("v").alias("y"), F.greatest(zero, end("u") - start("u")).alias("width"), F.greatest(zero, end("v") - start("v")).alias("height"))


def zones(rects: DataFrame, image_area: Column) -> DataFrame:
    """Boxes of 1 to 95 % of an image and an aspect of at most 8, by (y, x)."""
    area, aspect = F.col("area"), F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
    good = rects.where((area >= image_area * 0.01) & (area <= image_area * 0.95) & (aspect <= 8))
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "ord")) - 1
    return good.select("image_id", nth.cast("long").alias("zone"), "x", "y", "width", "height")


def coverage(found: DataFrame, image_area: Column, most: Column) -> DataFrame:
    share = F.sum(F.col("width") * F.col("height")).cast("double") / image_area
    n = F.count(F.lit(1))
    return found.groupBy("image_id").agg(n.alias("zones"), F.bround(share, 6).alias("coverage"), ((n >= 3) & (n <= most) & share.between(0.30, 1.5)).alias("use_smart_tiling"))


def split_by_median(rects: DataFrame) -> DataFrame:
    """Boxes of at least the median area are zones, others devices; with fewer than three boxes the limit is 50000."""
    split = rects.groupBy("image_id").agg(F.when(F.count(F.lit(1)) >= 3, F.percentile("area", F.lit(0.5))).otherwise(50000.0).alias("split"))
    return rects.join(split, "image_id").withColumn("kind", F.when(F.col("area") >= F.col("split"), "zone").otherwise("device"))


def to_image(segments: DataFrame) -> DataFrame:
    """Coordinates within a tile at (x, y) become coordinates of the image."""
    return segments.withColumns({c: F.col(c) + F.col(c[0]) for c in ("x1", "y1", "x2", "y2")})


def clamped(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes inside an image; what has no area left goes. Moving a corner inside doesn't take from the size."""
    zero = F.lit(0).cast("long")
    at = boxes.withColumn("x", F.greatest(zero, F.least(F.col("x"), F.lit(width - 1)))).withColumn("y", F.greatest(zero, F.least(F.col("y"), F.lit(height - 1))))
    return at.withColumn("width", F.least("width", width - F.col("x"))).withColumn("height", F.least("height", height - F.col("y"))).where("width > 0 and height > 0")
