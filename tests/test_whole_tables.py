"""Queries without SQL use every row of their tables."""

from pyspark.sql import functions as F

from quire.queries import QUERIES


def test_multi_file_chapters_uses_all_files_and_events(spark, tmp_path):
    # user 7 has headings of depth 2 in the fourth and fifth file's places too, user 2000 has no name
    users = (0, 3, 7, 8, 230, 2000)
    kinds = [("signup", 1.0), ("view", 2.0), ("purchase", 3.0), ("view", 4.0), ("purchase", 5.0), ("view", 6.0)]
    events = [(u * 10 + i, i, u, t, v, "{}") for u in users for i, (t, v) in enumerate(kinds)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"red part {k}") for k in range(900)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["multi_file_chapters"](spark, str(tmp_path)).cache()
    assert {(r.book_id, r.file_ord) for r in found.select("book_id", "file_ord").collect()} == {divmod(k, 5) for k in (*range(900), 2000)}
    per_file = {(r.book_id, r.file_ord): (r.n, r.blocks) for r in found.groupBy("book_id", "file_ord").agg(F.count("*").alias("n"), F.sum("n_blocks").alias("blocks")).collect()}
    # a lone top heading is the part of two chapters, which have one paragraph each, after an untitled opening
    assert len({per_file[divmod(u, 5)] for u in users}) == 1 and per_file[0, 0][1] == 3
    assert all(per_file[divmod(k, 5)] == (1, 0) for k in range(900) if k not in users)
