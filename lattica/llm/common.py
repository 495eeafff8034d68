"""What the operators of this subpackage share: reading tables, scratch tables, Arrow mapping, broadcast bounds."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts differ in length by orders of magnitude, so Arrow batches are kept to this many rows, and to this many bytes
#: unless one row has more.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory, by Spark's reader, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = f"file://{folder}"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again. It cuts the lineage, and what is lost with an executor is read, not recomputed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    path = df._lattica_path
    _delete(df.sparkSession, path)
    _scratch[:] = [x for x in _scratch if x[1] != path]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ARROW_ROWS rows and ARROW_BYTES bytes."""
    spark = df.sparkSession
    for name, most, usual in (("maxRecordsPerBatch", ARROW_ROWS, 10_000), ("maxBytesPerBatch", ARROW_BYTES, 64 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}", str(usual))))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm import common

        common.entered(owner)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


_owner = ""
_forget: list[Callable[[], None]] = []


def on_leaving(forget: Callable[[], None]) -> None:
    """Register what empties a module's tables when a worker goes on to another operator."""
    _forget.append(forget)


def entered(owner: str) -> None:
    """Workers are used again; tables that an operator before has filled are let go."""
    global _owner
    if owner != _owner:
        for forget in _forget:
            forget()
        gc.collect()
        _give_back()
        _owner = owner


def _give_back() -> None:
    """Memory that was freed goes back to the system; allocators would keep it, beside what the next operator takes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        return


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``rows`` rows, else ``df`` itself, whose join then shuffles. Count a written table only: the count is then read from its footers."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def env_threads() -> None:
    """One thread a task: executors run as many tasks as they have cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
