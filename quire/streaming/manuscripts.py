"""Structured Streaming beyond batch: text files that arrive in a folder become outline rows.

State is per file only: a file is parsed when it arrives, so there is nothing to wait for, no
watermark and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.markdown import outline, parse_files


def arriving_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = F.col("_metadata.file_path")
    return rows.select(F.xxhash64(name).alias("book_id"), F.lit(0).alias("file_ord"), F.element_at(F.split(name, "/"), -1).alias("file_name"), F.col("value").alias("content"))


def outlines(files: DataFrame) -> DataFrame:
    return outline(parse_files(files))


def write_outlines(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends outline rows as Parquet, each file once; ends when all present files are read."""
    return outlines(arriving_files(spark, path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
