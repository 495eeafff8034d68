"""Where results go: a markdown file beside each image, progress as an appended table, and images of the steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import exprs
from lattica.operators import resume


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_files(files: DataFrame) -> list[str]:
    """Write files (path, body: binary) from the executors, over what is there; the paths. Paths have to lead to a store that all of them share."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(*[c.to_pylist() for c in batch.columns]):
                store, place = _filesystem(path)
                store.create_dir(place.rpartition("/")[0] or ".", recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return sorted(r["path"] for r in files.select("path", "body").mapInArrow(fn, "path string").collect())


def write_reports(reports: DataFrame) -> list[str]:
    """Reports (image_id: the image's path, report) as UTF-8 beside the images, with the ending .md."""
    return write_files(reports.select(F.concat(exprs.without_extension(F.col("image_id")), F.lit(".md")).alias("path"), F.encode("report", "UTF-8").alias("body")))


def append_progress(answers: DataFrame, path: str, version: int) -> None:
    """Add answers (image_id, tile, result) to a progress table. Nothing is rewritten: of several answers the last version is read."""
    answers.select("image_id", "tile", "result", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_progress(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """image_id, tile, result: the last answer of each tile; none where there is no progress yet."""
    store, place = _place(spark, path)
    if not store.exists(place):
        return spark.createDataFrame([], f"image_id {kind}, tile long, result string")
    return resume.latest(spark.read.parquet(path)).select("image_id", "tile", "result")


def finish_progress(tiles: DataFrame, path: str) -> bool:
    """Remove a progress table if every tile (image_id, tile) has its answer there."""
    spark = tiles.sparkSession
    store, place = _place(spark, path)
    if not store.exists(place) or not tiles.join(read_progress(spark, path), ["image_id", "tile"], "left_anti").isEmpty():
        return False
    return bool(store.delete(place, True))


def console_text(piece, is_thinking):
    """How a piece of an answer is shown: dim while it is thinking."""
    return F.when(is_thinking, F.concat(F.lit("\x1b[2m"), piece, F.lit("\x1b[0m"))).otherwise(piece)


def to_console(pieces: DataFrame):
    """A query that shows a stream of pieces (response_id, piece_no, piece, is_thinking) as they come."""

    def show(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("response_id", "piece_no").select(console_text(F.col("piece"), F.col("is_thinking")).alias("shown")).toLocalIterator():
            print(r["shown"], end="", flush=True)

    return pieces.writeStream.foreachBatch(show).start()
