"""Runs that ingest only what has changed give what one run over everything gives."""

import os

from pyspark.sql import functions as F

from quire.plans.incremental import Library, changes, digests
from quire.plans.ingest import ingest_text

FILES, ANSWERS = "book_id long, file_ord int, file_name string, content string", "book_id long, id string, is_title boolean"
TEXT = "\t\tOne\n\nIt was a dark night.\n\n\t\tTwo\n\nThe end of {}.\n"


def same(library, files, answers):
    whole = ingest_text(files, answers)
    for name in ("status", "books", "chapters", "blocks"):
        want, got = getattr(whole, name), library.table(name)
        cols = sorted(want.columns)
        assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect())), name


def test_runs(spark, tmp_path):
    rows = {b: [(b, 0, "b.md", TEXT.format(b))] for b in range(6)} | {6: [(6, 0, "a.md", "# A\n\nx"), (6, 1, "b.md", "# B\n\ny")], 7: [(7, 0, "x.pdf", None)]}
    files = lambda: spark.createDataFrame([r for rs in rows.values() for r in rs], FILES)
    given = {(b, "b.md:0"): True for b in range(4)}
    answers = lambda: spark.createDataFrame([(*k, v) for k, v in given.items()], ANSWERS)
    library = Library(spark, f"file://{tmp_path}/library")
    assert library.table("books").count() == 0
    assert library.update(files(), answers()).count() == 8
    same(library, files(), answers())
    assert library.update(files(), answers()).count() == 0 and library.runs() == [1]
    # one changed answer: one book is ingested and written
    given[2, "b.md:0"] = False
    assert [tuple(r)[0] for r in library.update(files(), answers()).collect()] == [2]
    written = spark.read.parquet(f"{tmp_path}/library/chapters/run=2")
    assert {r.book_id for r in written.collect()} == {2} and library.runs() == [1, 2]
    same(library, files(), answers())
    # a new text, a new book, one that is gone
    rows[6][1] = (6, 1, "b.md", "# C\n\nz")
    rows[9] = [(9, 0, "n.md", "new")]
    del rows[3]
    assert {(r.book_id, r.digest is None) for r in library.update(files(), answers()).collect()} == {(6, False), (9, False), (3, True)}
    same(library, files(), answers().where("book_id <> 3"))
    # a run without digests, as one that failed leaves, counts for nothing
    spark.createDataFrame([(0, 5, "no", None, 1)], "book_id long, chapter_no int, title string, part string, n_blocks long").write.parquet(f"{tmp_path}/library/chapters/run=4")
    same(library, files(), answers().where("book_id <> 3"))
    library.compact()
    assert library.runs() == [4] and sorted(os.listdir(f"{tmp_path}/library/blocks")) == ["run=4"]
    same(library, files(), answers().where("book_id <> 3"))
    rows[3] = [(3, 0, "b.md", TEXT.format(3))]
    assert [r.book_id for r in library.update(files(), answers()).collect()] == [3]


def test_digests(spark):
    files = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None), (2, 0, "a", "x")], FILES)
    a = digests(files)
    assert changes(a, digests(files.orderBy(F.desc("file_ord")))).count() == 0
    assert {r.book_id for r in changes(a, digests(files.withColumn("file_ord", F.lit(1) - F.col("file_ord")))).collect()} == {1, 2}
    none = spark.createDataFrame([], ANSWERS)
    assert changes(digests(files, none), digests(files, spark.createDataFrame([(1, "a:0", None), (5, "a:0", True)], ANSWERS))).count() == 0
    assert changes(a.limit(0), a.limit(0)).count() == 0
