"""Progress of model calls as tables: what is cached, what is to do, and where a run stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cached(tiles: DataFrame, progress: DataFrame, from_tile: int = 0) -> DataFrame:
    """Tiles whose answers stand: they have one, and the run doesn't begin anew at or before them."""
    done = tiles.join(progress.select("image_id", "tile"), ["image_id", "tile"], "left_semi")
    return done if from_tile == 0 else done.where(F.col("tile") + 1 < from_tile)


def todo(tiles: DataFrame, progress: DataFrame, from_tile: int = 0) -> DataFrame:
    """Tiles to ask about: without an answer that stands, not before ``from_tile``, not skipped, and before the first ``quit`` of the image."""
    left = tiles.join(cached(tiles, progress, from_tile).select("image_id", "tile"), ["image_id", "tile"], "left_anti").where(F.col("tile") + 1 >= from_tile)
    quits = F.max((F.col("action") == "quit").cast("int")).over(Window.partitionBy("image_id").orderBy("tile"))
    return left.withColumn("quits", quits).where("quits = 0 and action = 'run'").drop("quits")


def answers(tiles: DataFrame, progress: DataFrame) -> DataFrame:
    """Each tile with its own answer, or none: answers are found by key, so a gap doesn't move them."""
    return tiles.join(progress.select("image_id", "tile", "result"), ["image_id", "tile"], "left").withColumn("result", F.coalesce("result", F.lit("")))


def latest(progress: DataFrame, version: str = "version") -> DataFrame:
    """Of all answers written for a tile, the last: how appended progress is read."""
    return progress.groupBy("image_id", "tile").agg(F.max_by("result", version).alias("result"))


def counted(tiles: DataFrame, progress: DataFrame) -> DataFrame:
    """image_id, done, total: how many tiles of an image have an answer."""
    done = progress.select("image_id", "tile").distinct().withColumn("done", F.lit(1))
    return tiles.join(done, ["image_id", "tile"], "left").groupBy("image_id").agg(F.count("done").alias("done"), F.count(F.lit(1)).alias("total"))
