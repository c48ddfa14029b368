"""Whole flows: files to books in two passes around reviewers' answers, and books to files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.operators import lines as L
from quire.operators import outline as O
from quire.plans.batches import parts
from quire.plans.folders import kept
from quire.sources.docx import explode_docx, read_docx
from quire.sources.markdown import metadata, outline, parse_files

CHAPTER = ["book_id", "chapter_no", "title", "part", "n_blocks"]
BLOCK = ["book_id", "chapter_no", "block_no", "kind", "runs"]


class Ingested:
    """status: book_id, status. candidates: book_id, id, text, before, after (none in a second pass).
    books, chapters, blocks: the books of status ok. counts: files, unreadable and items, observed
    while the files were parsed.

    Files are parsed when something that needs it is asked for, once, and the parsed rows are kept
    in the shared folder; candidates of texts don't need it. A book with a file that can't be read
    has status unreadable and no rows; other books aren't touched by it."""

    def __init__(self, routed: DataFrame, parse: Callable[[], DataFrame], candidates: Callable[[Ingested], DataFrame], build: Callable[[Ingested], tuple[DataFrame, DataFrame, DataFrame]]):
        self._routed, self._parse, self._candidates, self._build = routed, parse, candidates, build
        self._seen = Observation()

    @cached_property
    def parsed(self) -> DataFrame:
        counts = [F.count("*").alias("files"), F.count("error").alias("unreadable"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items")]
        return kept(self._parse().observe(self._seen, *counts))

    @property
    def counts(self) -> dict[str, int]:
        _ = self.parsed
        return self._seen.get

    @cached_property
    def failed(self) -> DataFrame:
        """book_id, error: one of each book that can't be read."""
        return self.parsed.where("error is not null").groupBy("book_id").agg(F.min("error").alias("error"))

    @cached_property
    def readable(self) -> DataFrame:
        return self.parsed.join(self.failed, "book_id", "left_anti")

    @cached_property
    def status(self) -> DataFrame:
        return B.with_unreadable(self._routed, self.failed)

    @cached_property
    def candidates(self) -> DataFrame:
        return self._candidates(self)

    @cached_property
    def _built(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._build(self)

    @property
    def books(self) -> DataFrame:
        return self._built[0]

    @property
    def chapters(self) -> DataFrame:
        return self._built[1]

    @property
    def blocks(self) -> DataFrame:
        return self._built[2]


def ingest_text(files: DataFrame, decisions: DataFrame | None = None) -> Ingested:
    """files: book_id, file_ord, file_name, content. decisions: book_id, id, is_title.

    Without decisions the books are what the undecided text gives, and candidates are to be asked
    about; with decisions confirmed lines are headings and declined ones prose."""
    routed = B.ingest_status(files)
    ok = B.route(files).where("route = 'text'").drop("route").join(routed.where("status = 'ok'").select("book_id"), "book_id", "left_semi")
    ok = B.natural_order(ok).select("book_id", "file_ord", "file_name", "content")
    reviewed = L.review(ok)
    text = ok if decisions is None else L.apply_answers(L.with_answers(reviewed, decisions)).drop("candidates")
    asked = L.candidate_rows(reviewed).select("book_id", "id", "text", "before", "after")

    def build(self: Ingested) -> tuple[DataFrame, DataFrame, DataFrame]:
        parsed = self.readable
        n_files = F.count("*").over(Window.partitionBy("book_id"))
        named = kept(parsed.select("book_id", "file_ord", "file_name", n_files.cast("int").alias("n_files")))
        segments = kept(B.file_segments(outline(parsed), named))
        chapters = B.file_chapters(segments, named)
        titles = segments.where("n_files = 1").groupBy("book_id").agg(F.max("book_title").alias("found_title"))
        single = named.where("n_files = 1").select("book_id", "file_name")
        meta = metadata(parsed).join(single, "book_id", "left").join(titles, "book_id", "left").withColumn("title", F.coalesce("title", "found_title"))
        return B.finish(meta).drop("found_title", "file_name"), chapters.select(CHAPTER), B.file_blocks(segments, chapters).select(BLOCK)

    return Ingested(routed, lambda: parse_files(text), lambda _: asked if decisions is None else asked.where("false"), build)


def ingest_docx(files: DataFrame, decisions: DataFrame | None = None) -> Ingested:
    """The same for Word files (book_id, file_name, content), one a book. Books without any heading
    are cut at lines that read as chapter titles."""
    routed = B.ingest_status(files)
    ok = files.join(routed.where("status = 'ok'").select("book_id"), "book_id", "left_semi")

    def found(self: Ingested) -> DataFrame:
        return L.with_ids(L.centered_paragraphs(explode_docx(self.readable)))

    def build(self: Ingested) -> tuple[DataFrame, DataFrame, DataFrame]:
        paras = explode_docx(self.readable)
        if decisions is not None:
            answers = L.answered(found(self), decisions).where("is_title is not null").select("book_id", F.col("idx").alias("para_no"), "is_title")
            paras = B.apply_paragraph_decisions(paras, answers)
        marked = paras.withColumn("any", F.max(F.col("heading").isNotNull()).over(Window.partitionBy("book_id")))
        styled = O.segments(O.paragraph_outline(marked.where("any")), ["book_id"])
        plain = O.segments(O.line_outline(marked.where("not any")), ["book_id"], detect=False)
        segments = kept(styled.unionByName(plain))
        titles = segments.groupBy("book_id").agg(F.max("book_title").alias("found"))
        none = F.lit(None).cast("string")
        books = self.readable.select("book_id", "file_name").join(titles, "book_id", "left").select("book_id", F.coalesce("found", T.title_from_filename(F.col("file_name"), keep_number=True)).alias("title"), F.lit("").alias("author"), *[none.alias(c) for c in ("legal_name", "address", "email", "phone", "language")])
        return books, O.with_empty_books(O.chapters(segments, ["book_id"]).select(CHAPTER), books), O.blocks(segments, ["book_id"]).select(BLOCK)

    def asked(self: Ingested) -> DataFrame:
        rows = found(self).drop("idx")
        return rows if decisions is None else rows.where("false")

    return Ingested(routed, lambda: read_docx(ok), asked, build)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes file_name, data to folder/<book_id>-<file_name>; returns book_id, path. A file is written
    under a name of the attempt's own and then moved, so a second attempt replaces it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(top, recursive=True)
        for batch in parts(batches):
            paths = []
            for row in batch.to_pylist():
                path, own = f"{top}/{row['book_id']}-{row['file_name']}", f"{top}/.{uuid.uuid4().hex}"
                with where.open_output_stream(own) as out:
                    out.write(row["data"])
                where.move(own, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(paths, pa.string())], names=["book_id", "path"])

    return rows.select("book_id", "file_name", "data").mapInArrow(run, f"book_id {rows.schema['book_id'].dataType.simpleString()}, path string")
