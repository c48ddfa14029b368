"""Stored tables join without a shuffle, and give what the frames give."""

import os

from pyspark.sql import functions as F

from quire.operators import lines as L
from quire.plans import stored as S


def test_no_exchange_below_the_join(spark, tmp_path):
    found = spark.range(2000).select((F.col("id") % 50).alias("book_id"), F.concat(F.lit("f:"), "id").alias("id"), F.lit("t").alias("text"))
    answers = found.where("book_id % 3 > 0").select("book_id", "id", (F.col("book_id") % 3 == 1).alias("is_title"))
    keys = ["book_id", "id"]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = S.store(found, keys, 6, folder=f"file://{tmp_path}/a", name="asked_once"), S.store(answers, keys, 6, folder=f"file://{tmp_path}/b")
        assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]) == 6
        joined = L.answered(a, b)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert sorted(joined.collect()) == sorted(L.answered(found, answers).collect())
        again = S.attach(spark, "book_id LONG, id STRING, is_title BOOLEAN", keys, 6, f"file://{tmp_path}/b")
        plan = L.answered(a, again)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and L.answered(a, again).where("is_title").count() == answers.where("is_title").count()
        S.drop(spark, "asked_once")
        assert not os.path.exists(tmp_path / "a") and not spark.catalog.tableExists("asked_once")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
