"""Whole books: file routing, ingest status, several files in one book, word counts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import outline as O

TEXT_FILE = r"(?i)\.(md|markdown|mdown|txt)\z"
WORD_FILE = r"(?i)\.docx\z"


def route(files: DataFrame) -> DataFrame:
    """Adds route: text, docx or other."""
    return files.withColumn("route", F.when(F.col("file_name").rlike(TEXT_FILE), "text").when(F.col("file_name").rlike(WORD_FILE), "docx").otherwise("other"))


def ingest_status(files: DataFrame) -> DataFrame:
    """book_id, status: mixed, multi_docx, unsupported or ok, in this order of precedence."""
    g = route(files).groupBy("book_id").agg(F.count_if(F.col("route") == "text").alias("n_text"), F.count_if(F.col("route") == "docx").alias("n_docx"))
    status = F.when((F.col("n_text") > 0) & (F.col("n_docx") > 0), "mixed").when(F.col("n_docx") > 1, "multi_docx").when(F.col("n_text") + F.col("n_docx") == 0, "unsupported").otherwise("ok")
    return g.select("book_id", status.alias("status"))


def with_unreadable(status: DataFrame, failed: DataFrame) -> DataFrame:
    """status (book_id, status) in which books of `failed` (book_id, a row each) that were ok are
    unreadable: what can't be told from names comes last."""
    f = failed.select("book_id", F.lit(True).alias("_failed"))
    return status.join(f, "book_id", "left").select("book_id", F.when((F.col("status") == "ok") & F.col("_failed"), "unreadable").otherwise(F.col("status")).alias("status"))


def natural_order(files: DataFrame) -> DataFrame:
    """Replaces file_ord by the place in natural order of names; ties keep their order."""
    w = Window.partitionBy("book_id").orderBy(T.natural_key(F.col("file_name")), "file_ord")
    return files.withColumn("file_ord", (F.row_number().over(w) - 1).cast("int"))


def chapter_words(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds words to chapters (book_id, chapter_no, ...): only paragraphs count."""
    n = blocks.where("kind = 'paragraph'").groupBy("book_id", "chapter_no").agg(F.sum(T.words(T.run_text(F.col("runs")))).alias("words"))
    return chapters.join(n, ["book_id", "chapter_no"], "left").withColumn("words", F.coalesce("words", F.lit(0)))


def book_words(counted: DataFrame) -> DataFrame:
    """book_id, words, about_words, n_chapters, summary from chapters with words."""
    g = counted.groupBy("book_id").agg(F.sum("words").alias("words"), F.count("*").alias("n_chapters"))
    g = g.withColumn("about_words", T.manuscript_words(F.col("words")))
    about = F.concat(F.lit("about "), F.format_number("about_words", 0), F.lit(" words"))
    return g.withColumn("summary", F.when(F.col("n_chapters") > 1, F.concat(F.format_number("n_chapters", 0), F.lit(" chapters, "), about)).otherwise(about))


def file_segments(outlines: DataFrame, files: DataFrame) -> DataFrame:
    """Segments of each file (book_id, file_ord) of `files`, with n_files, the files of its book."""
    keys = ["book_id", "file_ord"]
    o = outlines.join(files.select(*keys, "n_files"), keys)
    return O.segments(o, keys, by_file=F.col("n_files") > 1)


def file_chapters(segmented: DataFrame, files: DataFrame) -> DataFrame:
    """book_id, chapter_no, file_ord, seg, title, part, n_blocks of books whose segments are keyed by
    book_id, file_ord. files: book_id, file_ord, file_name, n_files.

    In a book of several files, a lone top heading over several chapters of a file is their part;
    over one chapter it was the chapter's title. A file's single untitled chapter is named after it,
    as a file without any chapter is. A book of one file without any has one untitled chapter."""
    keys = ["book_id", "file_ord"]
    found = O.chapters(segmented, keys, carry=("book_title",)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).drop("chapter_no")
    both = files.select(*keys, "file_name", "n_files").join(found, keys, "left")
    several = F.col("n_files") > 1
    title = F.coalesce("title", F.lit(""))
    alone = several & (F.coalesce("n", F.lit(1)) == 1) & (title == "")
    both = both.withColumn("title", F.when(alone, T.title_from_filename(F.col("file_name"))).otherwise(title)).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    both = both.withColumn("part", F.coalesce("part", F.when(several, F.col("book_title")))).withColumn("seg", F.coalesce("seg", F.lit(0)))
    both = both.where(~several | (F.col("title") != "") | (F.col("n_blocks") > 0))
    order = Window.partitionBy("book_id").orderBy("file_ord", "seg")
    return both.select("book_id", (F.row_number().over(order) - 1).cast("int").alias("chapter_no"), "file_ord", "seg", "title", "part", "n_blocks")


def file_blocks(segmented: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, chapter_no, block_no, kind, runs: blocks with the numbers that file_chapters gave.
    One row a chapter is joined."""
    keys = ["book_id", "file_ord", "seg"]
    body = segmented.where("chapter_no is not null and not is_chapter")
    w = Window.partitionBy(*keys).orderBy("item_no")
    body = body.select(*keys, (F.row_number().over(w) - 1).cast("int").alias("block_no"), "kind", "runs")
    return body.join(chapters.select(*keys, "chapter_no"), keys).drop("file_ord", "seg")


def chapter_list(counted: DataFrame) -> DataFrame:
    """book_id, seq, kind (part or chapter), label, words: the rows of a book's contents."""
    c = O.part_starts(counted)
    row = F.struct(F.lit(1).alias("k"), F.lit("chapter").alias("kind"), T.first_filled(F.col("title"), F.concat(F.lit("Chapter "), F.col("chapter_no") + 1)).alias("label"), F.col("words").alias("words"))
    part = F.struct(F.lit(0).alias("k"), F.lit("part").alias("kind"), F.col("part").alias("label"), F.lit(None).cast("long").alias("words"))
    rows = c.select("book_id", "chapter_no", F.explode(F.when(F.col("new_part_web"), F.array(part, row)).otherwise(F.array(row))).alias("x")).select("book_id", "chapter_no", "x.*")
    w = Window.partitionBy("book_id").orderBy("chapter_no", "k")
    return rows.select("book_id", (F.row_number().over(w) - 1).alias("seq"), "kind", "label", "words")


def _opening(blocks: DataFrame, k: int) -> DataFrame:
    """The first k paragraphs of the first chapter, numbered from 1 as para."""
    w = Window.partitionBy("book_id").orderBy("block_no")
    return blocks.where("chapter_no = 0 and kind = 'paragraph'").withColumn("para", F.row_number().over(w)).where(F.col("para") <= k)


def _lines(df: DataFrame, *lines: tuple[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i - len(lines)).alias("o"), F.lit(role).alias("role"), text.alias("text")) for i, (role, text) in enumerate(lines)])
    return df.select("book_id", F.explode(F.filter(rows, lambda r: r["text"].isNotNull())).alias("x")).select("book_id", "x.*")


def _numbered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("o")
    return rows.select("book_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "role", "text")


def manuscript_preview(books: DataFrame, words: DataFrame, blocks: DataFrame, k: int = 2) -> DataFrame:
    """book_id, seq, role, text: contact, email, count, title, byline and the first k paragraphs."""
    b = books.join(words.select("book_id", "about_words"), "book_id", "left")
    about = F.coalesce("about_words", T.manuscript_words(F.lit(0)))
    name = T.first_filled(F.col("legal_name"), F.col("author"), "Your Name")
    head = _lines(
        b,
        ("contact", name),
        ("email", F.nullif("email", F.lit(""))),
        ("count", F.concat(F.lit("about "), F.format_number(about, 0), F.lit(" words"))),
        ("title", T.first_filled(F.col("title"), "Untitled")),
        ("byline", F.concat(F.lit("by "), T.first_filled(F.col("author"), "Anonymous"))),
    )
    body = _opening(blocks, k).select("book_id", F.col("para").alias("o"), F.lit("paragraph").alias("role"), T.run_text(F.col("runs")).alias("text"))
    return _numbered(head.unionByName(body))


def ebook_preview(books: DataFrame, chapters: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """book_id, seq, role (title, first, paragraph), text (styled runs): the first chapter's title,
    or the book's, and its first k paragraphs. Books without chapters have none."""
    b = chapters.where("chapter_no = 0").select("book_id", F.col("title").alias("chapter_title")).join(books, "book_id")
    head = _lines(b, ("title", T.first_filled(F.col("chapter_title"), F.col("title"), "Chapter One")))
    role = F.when(F.col("para") == 1, "first").otherwise("paragraph")
    body = _opening(blocks, k).select("book_id", F.col("para").alias("o"), role.alias("role"), T.runs_xhtml(F.col("runs")).alias("text"))
    return _numbered(head.unionByName(body))


def finish(books: DataFrame) -> DataFrame:
    """Metadata with its defaults: title from the file name, author empty."""
    title = F.coalesce(F.col("title"), F.when(T.first_filled(F.col("file_name"), "") != "", T.title_from_filename(F.col("file_name"))), F.lit(""))
    return books.withColumn("title", title).withColumn("author", F.coalesce("author", F.lit("")))


def patch(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides metadata by changes (book_id, field, value); an empty optional value is none."""
    g = changes.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    out = books.join(g, "book_id", "left")
    for c in [c for c in books.columns if c != "book_id"]:
        new = F.col("m")[c] if c in ("title", "author") else F.nullif(F.col("m")[c], F.lit(""))
        out = out.withColumn(c, F.when(F.coalesce(F.map_contains_key("m", F.lit(c)), F.lit(False)), new).otherwise(F.col(c)))
    return out.drop("m")


def apply_paragraph_decisions(paras: DataFrame, decisions: DataFrame) -> DataFrame:
    """Answers (book_id, para_no, is_title) about paragraphs: confirmed ones become headings of the
    promotion depth, declined ones lose their edges' white space; headings stay."""
    from quire.operators.lines import promotion_depth

    p = paras.withColumn("file_ord", F.lit(0))
    opens = p.groupBy("book_id", "file_ord").agg(F.min_by(F.col("heading").isNotNull(), "para_no").alias("opens"))
    depths = promotion_depth(p.where("heading is not null").select("book_id", "file_ord", F.col("heading").alias("depth"), F.col("para_no").alias("ord")), opens)
    p = p.join(decisions, ["book_id", "para_no"], "left").join(depths, ["book_id", "file_ord"])
    open_ = F.col("heading").isNull()
    title = open_ & F.coalesce("is_title", F.lit(False))
    plain = F.array(F.struct(T.trim(T.run_text(F.col("runs"))).alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold")))
    runs = F.when(title, plain).when(open_ & F.col("is_title").isNotNull(), T.trim_edges(F.col("runs"))).otherwise(F.col("runs"))
    return p.select("book_id", "para_no", F.when(title, F.col("depth")).otherwise(F.col("heading")).alias("heading"), "centered", runs.alias("runs"))
