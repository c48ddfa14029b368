"""Tables that are stored by their join keys, so that passes over them shuffle neither side.

    candidates = store(found, ["book_id", "id"], 200)
    decisions = store(answers, ["book_id", "id"], 200)
    answered(candidates, decisions)  # a sort-merge join without an exchange below it

A table is dealt into a fixed number of buckets by a hash of its keys, each one file that is sorted
by them. Two tables join without a shuffle if both have the join's keys and the same number of
buckets; both may be read as often as answers change. Choose buckets so that one fits a task at the
size to come: 100 TB in 200,000 buckets are 500 MB each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.plans.folders import drop_folder, new_folder


def store(rows: DataFrame, keys: list[str], buckets: int, folder: str | None = None, name: str | None = None) -> DataFrame:
    """Writes the rows and returns them as read from there. folder: in the shared folder unless
    given. name: of the table in the session's catalog, made up unless given."""
    spark = rows.sparkSession
    name, folder = name or f"stored_{uuid.uuid4().hex}", folder or new_folder(spark, "stored")
    dealt = rows.repartition(buckets, *keys)  # as buckets are dealt, so each task writes one file
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def attach(spark: SparkSession, schema: str, keys: list[str], buckets: int, folder: str, name: str | None = None) -> DataFrame:
    """A stored table of another session, by its folder."""
    name = name or f"stored_{uuid.uuid4().hex}"
    columns = ", ".join(keys)
    spark.sql(f"CREATE TABLE `{name}` ({schema}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    """Removes a stored table and its folder."""
    where = [r.data_type for r in spark.sql(f"DESCRIBE FORMATTED `{name}`").collect() if r.col_name == "Location"]
    spark.sql(f"DROP TABLE `{name}`")
    for folder in where:
        drop_folder(spark, folder)
