"""Two-pass ingest, writing, reading and streaming."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.plans import docx as D
from quire.plans.ingest import ingest_docx, ingest_text, write_files
from quire.sources.docx import read_docx_files, read_text_files
from quire.streaming.manuscripts import write_outlines

FILES = "book_id long, file_ord int, file_name string, content string"
TEXT = "\t\tOne\n\nIt was a dark night.\n\n\t\tno title\n\nMore.\n\n\t\tTwo\n\nThe end of it.\n"


def test_two_passes(spark):
    files = spark.createDataFrame([(1, 0, "b.md", TEXT), (2, 0, "a.md", "# H\n\ntext"), (3, 0, "x.md", "a"), (3, 1, "y.docx", "b")], FILES)
    first = ingest_text(files)
    assert {(r.book_id, r.id) for r in first.candidates.collect()} == {(1, "b.md:0"), (1, "b.md:4"), (1, "b.md:8")}
    assert dict(r for r in first.status.collect()) == {1: "ok", 2: "ok", 3: "mixed"}
    answers = spark.createDataFrame([(1, "b.md:0", True), (1, "b.md:4", False), (1, "b.md:8", True)], "book_id long, id string, is_title boolean")
    second = ingest_text(files, answers)
    assert second.candidates.count() == 0
    counted = B.chapter_words(second.chapters, second.blocks)
    assert [(r.title, r.words) for r in counted.where("book_id = 1").orderBy("chapter_no").collect()] == [("One", 8), ("Two", 4)]
    assert second.books.where("book_id = 1").first().title == "b"


def test_candidates_need_no_parse(spark):
    first = ingest_text(spark.createDataFrame([(1, 0, "b.md", TEXT)], FILES))
    assert first.candidates.count() == 3 and "parsed" not in vars(first)


def test_unreadable_files(spark):
    """A hostile text and a broken archive cost their own books only, and are counted."""
    texts = [(1, 0, "a.md", "# A\n\nx"), (2, 0, "b.md", ">" * 1500 + " x"), (3, 0, "c.md", "- " * 1200 + "x"), (4, 0, "d.md", "fine"), (5, 0, "e.md", "good\n"), (5, 1, "f.md", ">" * 5000), (6, 0, "g.pdf", "x"), (7, 0, "h.md", None)]
    got = ingest_text(spark.createDataFrame(texts, FILES).coalesce(1))
    status = {1: "ok", 2: "unreadable", 3: "unreadable", 4: "ok", 5: "unreadable", 6: "unsupported", 7: "ok"}
    assert dict(r for r in got.status.collect()) == status
    assert {r.book_id for r in got.books.collect()} == {r.book_id for r in got.chapters.collect()} == {1, 4, 7}
    assert got.counts == {"files": 7, "unreadable": 3, "items": 4}
    assert {r.error for r in got.failed.collect()} == {"RecursionError"}
    whole = D.pack(got.books.where("book_id = 1"), D.paragraphs(got.books, got.chapters, got.blocks).where("book_id = 1"), B.book_words(B.chapter_words(got.chapters, got.blocks)))
    data = bytes(whole.first().data)
    broken = data[: len(data) // 2] + b"xx" + data[len(data) // 2 + 40 :]
    files = spark.createDataFrame([(1, "a.docx", data), (2, "b.docx", b"no archive"), (3, "c.docx", None), (4, "d.docx", broken)], "book_id long, file_name string, content binary")
    read = ingest_docx(files.coalesce(1))
    assert dict(r for r in read.status.collect()) == {1: "ok", 2: "unreadable", 3: "unreadable", 4: "unreadable"}
    assert {r.book_id for r in read.chapters.collect()} == {1} == {r.book_id for r in read.books.collect()} and read.counts["unreadable"] == 3


def test_several_files(spark):
    files = spark.createDataFrame([(1, 0, "10-c.md", "# Ten\n\nx"), (1, 1, "2-b.txt", "text two words"), (1, 2, "1-a.md", "# P\n\n## A\n\nx\n\n## B\n\ny")], FILES)
    got = ingest_text(files)
    assert [(r.title, r.part, r.n_blocks) for r in got.chapters.orderBy("chapter_no").collect()] == [("A", "P", 1), ("B", "P", 1), ("b", None, 1), ("Ten", None, 1)]
    text = got.blocks.orderBy("chapter_no", "block_no").select(T.run_text(F.col("runs"))).collect()
    assert [r[0] for r in text] == ["x", "y", "text two words", "x"] and got.books.first().title == ""


def test_write_and_read(spark, tmp_path):
    files = spark.createDataFrame([(1, 0, "my_book.md", "Chapter One\n\nA *line* of text.\n\nChapter Two\n\nMore of it.\n")], FILES)
    got = ingest_text(files)
    books = got.books
    words = B.book_words(B.chapter_words(got.chapters, got.blocks))
    assert write_files(D.pack(books, D.paragraphs(books, got.chapters, got.blocks), words), f"{tmp_path}/out").count() == 1
    back = ingest_docx(read_docx_files(spark, f"{tmp_path}/out"))
    titles = [r.title for r in back.chapters.orderBy("chapter_no").collect()]
    assert titles == ["", "Chapter One", "Chapter Two"]
    (tmp_path / "texts").mkdir()
    for n, t in (("10.md", "ten"), ("9.txt", "nine"), ("x.pdf", "no")):
        (tmp_path / "texts" / n).write_text(t)
    assert [(r.file_ord, r.file_name) for r in read_text_files(spark, f"{tmp_path}/texts").orderBy("file_ord").collect()] == [(0, "9.txt"), (1, "10.md")]
    write_outlines(spark, f"{tmp_path}/texts/*.md", f"{tmp_path}/stream", f"{tmp_path}/check").awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/stream").collect()] == ["ten"]
