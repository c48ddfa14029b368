"""Running values over ranges are those over whole books."""

import random

from pyspark.sql import functions as F

from quire.operators import html as H
from quire.operators import outline as O
from quire.operators import ranges as W

ITEM = "book_id long, item_no int, kind string, depth int, text string, runs array<struct<text:string,italic:boolean,bold:boolean>>"


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_segments(spark):
    rng = random.Random(6)
    rows = []
    for b in range(120):
        depths, gap = rng.choice([[None, None, 1, 2, 2], [None] * 6 + [1, 2, 2, 3], [1, 2], [None], [2, 2, None, 1]]), rng.choice([1, 1, 3, 40])
        for i in range(rng.randint(1, 40)):
            d = rng.choice(depths)
            rows.append((b, i * gap, "heading" if d else rng.choice(["paragraph", "scene-break"]), d, f"t{b}-{i}", [(f"r{i}", False, False)]))
    o = spark.createDataFrame(rows, ITEM).repartition(5).cache()
    for detect in (True, False):
        want = rows_of(O.segments(o, ["book_id"], detect))
        for width in (1, 3, 7, 1000):
            assert rows_of(W.segments(o, ["book_id"], detect, width)) == want, (detect, width)
    assert len({r.part for r in O.segments(o, ["book_id"]).collect()}) > 10


def test_clamped(spark):
    rng = random.Random(7)
    pages = [(b, "".join(rng.choice(["<i>", "</i>", "<em>", "</em>", "<b>", "</b>", "</strong>", "x", "<p>"]) for _ in range(rng.randint(0, 60)))) for b in range(60)]
    t = H.tags(H.tokens(spark.createDataFrame(pages, "book_id long, html string"))).cache()
    want = rows_of(H.styles(t))
    for width in (1, 4, 9, 1000):
        assert rows_of(W.clamped(t, ["book_id"], "tok_no", H.style_steps(), width)) == want


def test_one_book_is_many_tasks(spark):
    n = 200_000
    kind = F.when(F.col("item_no") % 1000 == 0, "heading").otherwise("paragraph")
    o = spark.range(n).select(F.lit(1).alias("book_id"), F.col("id").cast("int").alias("item_no")).withColumn("kind", kind)
    o = o.withColumn("depth", F.when(F.col("kind") == "heading", F.when(F.col("item_no") % 20_000 == 0, 1).otherwise(2)).cast("int"))
    o = o.withColumn("text", F.concat(F.lit("t"), "item_no")).withColumn("runs", F.array().cast("array<struct<text:string,italic:boolean,bold:boolean>>"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seg = W.segments(o, ["book_id"], width=5_000)
        per_task = [r.n for r in seg.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        ends = seg.where("chapter_no is not null").agg(F.max("chapter_no").alias("c"), F.max("seg").alias("s"), F.count_distinct("part").alias("p")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(per_task) > 2 and max(per_task) < 0.6 * n and sum(per_task) == n
    assert tuple(ends) == (199, 200, 10)
