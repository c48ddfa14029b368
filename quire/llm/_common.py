"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the
    context's checkpoint folder. Where neither is set, a temporary one is made if the driver is all
    there is (local tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-checkpoints-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, as a URI."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of the shared store, by Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of one column, one row at least."""
    for batch in batches:
        col = batch.column(name)
        sizes = [len(x.as_buffer()) if (x := v).is_valid else 0 for v in col]
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory to the system: workers stay for later tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, key: str = "spark.sql.execution.arrow.maxBytesPerBatch", size: str = "4m") -> None:
    """Batches on the way to Python workers of a few MB, where the session has only Spark's default
    of 64 MB: each lies in memory several times over."""
    if not spark.sparkContext.getConf().contains(key) and spark.conf.get(key) in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
