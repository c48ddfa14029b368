"""Frames of manuscripts made from the driver's tables by fixed rules, so that the operators have
structure to work on. Expressions in SHARED hold in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TITLE = """CASE WHEN book_id % 5 = 0 THEN '' WHEN book_id % 5 = 1 THEN 'The "Long" & <Winding> Road' || book_id WHEN book_id % 5 = 2 THEN 'Tide''s End' ELSE 'Title ' || book_id END"""
AUTHOR = "CASE WHEN book_id % 3 = 0 THEN NULL ELSE 'Ann B. Writer' || book_id END"
SHARED = {
    "title": TITLE,
    "author": AUTHOR,
    "legal_name": "CASE WHEN book_id % 4 = 0 THEN 'Anna Legal' WHEN book_id % 4 = 1 THEN '' END",
    "address": "CASE WHEN book_id % 2 = 0 THEN '1 Long Road' || chr(10) || chr(10) || 'Town ' || book_id END",
    "email": "CASE WHEN book_id % 7 < 5 THEN 'a' || book_id || '@mail.example.com' ELSE '' END",
    "phone": "CASE WHEN book_id % 7 = 3 THEN '555-01' || (book_id % 90 + 10) END",
    "language": "CASE WHEN book_id % 6 = 0 THEN 'de' END",
    "uuid": "'urn:uuid:' || book_id",
    "modified": "'2024-01-01T00:00:00Z'",
    "cover": "CASE WHEN book_id % 4 = 1 THEN 'png' WHEN book_id % 4 = 3 THEN 'jpg' END",
}
#: What stands at line n of document d (x) in a manuscript: the line whole, marked or after a line that gives the text structure.
GAP = "chr(10) || chr(10)"
LINE = (
    f"CASE (d + n) % 9 WHEN 0 THEN '# ' || x WHEN 2 THEN '          Scene ' || n || {GAP} || x WHEN 3 THEN chr(9) || chr(9) || x WHEN 4 THEN chr(9) || chr(9) || 'Song of ' || (d + n) || {GAP} || x WHEN 5 THEN '  ## ' || x "
    f"WHEN 7 THEN '* * *' || {GAP} || x WHEN 8 THEN '~~~~' || {GAP} || x ELSE x END"
)
#: Front matter of document doc_id: quoted values, values that aren't strings, second names of a field, none, one that comes too late.
FRONT = (
    "CASE doc_id % 5 WHEN 0 THEN '---' || chr(10) || 'title: \"The ' || doc_id || '\"' || chr(10) || 'author: Ann B ' || doc_id || chr(10) || 'email: 12' || chr(10) || '---' || chr(10) "
    "WHEN 1 THEN '---' || chr(10) || 'title: ' || doc_id || chr(10) || 'name: Real Name' || chr(10) || 'lang: de' || chr(10) || '---' || chr(10) "
    "WHEN 3 THEN chr(10) || '---' || chr(10) || 'title: late' || chr(10) || '---' || chr(10) "
    "WHEN 4 THEN '---' || chr(10) || 'legalName: A B' || chr(10) || 'legal-name: C D' || chr(10) || 'language: true' || chr(10) || 'lang: fr' || chr(10) || 'email: a@b.example.com' || chr(10) || '---' || chr(10) ELSE 'Title: none' || chr(10) END"
)
#: A line of structure before turn `turn` of conversation `conv_id`, or null.
SPOKEN_LINE = (
    "CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'Chapter ' || (conv_id % 30) || ': Rain' WHEN turn = 0 AND conv_id % 3 = 1 THEN '  Part two.  ' WHEN turn = 1 AND conv_id % 4 = 0 THEN chr(9) || chr(9) || 'Voice ' || conv_id || ' ' "
    "WHEN turn = 2 AND conv_id % 4 = 1 THEN ' # ' WHEN turn = 3 AND conv_id % 6 = 0 THEN 'Hymn ' || conv_id END"
)
#: Files of a part number's books: one to six, by number.
NAMED_BOOK = "p_partkey - p_partkey % (1 + cast(floor(p_partkey / 60) as bigint) % 6)"
#: Names with several numbers, letters with accents and of both cases, and names that are the same.
VARIED = (
    "CASE file_ord % 6 WHEN 0 THEN 'Teil ' || (book_id % 12) || ' Kap ' || (file_ord * 7 % 13) || '.md' WHEN 1 THEN 'teil ' || (book_id % 12) || ' kap ' || (file_ord * 5 % 13) || '.md' WHEN 2 THEN 'téil 00' || (file_ord * 3 % 12) || '.md' "
    "WHEN 3 THEN 'Äpfel-' || (file_ord % 2) || '_' || (book_id % 10) || '.txt' WHEN 4 THEN 'zebra10b' || (file_ord * 11 % 102) || '.md' ELSE file_name END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file a document, with a blank line between lines; every third opens with front matter."""
    lines = F.expr(f"transform(split(text, '\\n'), (x, n) -> {LINE.replace('d + n', 'doc_id + n')})")
    front = F.expr("CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END")
    content = F.concat(front, F.array_join(lines, "\n\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("file_ord"), F.expr("'book-' || doc_id || '.md'").alias("file_name"), content.alias("content"))


def front_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file a document, with front matter of several kinds before the whole text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("file_ord"), F.lit("a.md").alias("file_name"), F.expr(f"{FRONT} || chr(10) || text").alias("content"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, file_ord, file_name, p_partkey: names with numbers and extensions of all kinds."""
    name = F.expr("p_partkey % 113 || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '_' END || replace(p_name, ' ', '_') || CASE p_partkey % 11 WHEN 0 THEN '.docx' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '.markdown' ELSE '.md' END")
    w = Window.partitionBy("book_id").orderBy("p_partkey")
    parts = table(spark, sf_dir, "part").withColumn("book_id", F.expr(NAMED_BOOK))
    return parts.select("book_id", (F.row_number().over(w) - 1).cast("int").alias("file_ord"), name.alias("file_name"), "p_partkey")


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), "html")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a book: signups of a low value are headings of depth 1, purchases of depth
    2, errors scene breaks. Every third book starts with a heading of depth 1."""
    w = Window.partitionBy("book_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "book_id").withColumn("item_no", (F.row_number().over(w) - 1).cast("int"))
    e = e.withColumn("depth", F.expr("CASE WHEN book_id % 3 = 0 AND item_no = 0 OR event_type = 'signup' AND value < 10 THEN 1 WHEN event_type = 'purchase' THEN 2 END"))
    kind = F.expr("CASE WHEN depth IS NOT NULL THEN 'heading' WHEN event_type = 'error' THEN 'scene-break' ELSE 'paragraph' END")
    e = e.withColumn("kind", kind).withColumn("text", F.expr("event_type || ' ' || event_id || ' & <' || value || '>'"))
    runs = F.when(F.col("kind") == "paragraph", F.array(F.struct("text", (F.col("event_id") % 5 == 0).alias("italic"), (F.col("event_id") % 7 == 0).alias("bold")), F.struct(F.lit(" end").alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold"))))
    return e.select("book_id", F.lit(0).alias("file_ord"), "item_no", "kind", "depth", "text", runs.alias("runs"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id")).distinct()
    return ids.select("book_id", *[F.expr(v).alias(k) for k, v in SHARED.items()])


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paragraphs, four to a book, with lines of structure between them: chapter
    lines, parts, scene breaks, titles that tabs or a style center."""
    c = table(spark, sf_dir, "conversations").withColumn("book_id", F.floor(F.col("conv_id") / 4))
    own = F.array(F.struct(F.lit(1).alias("k"), F.col("text").alias("text")))
    c = c.withColumn("line", F.expr(SPOKEN_LINE))
    c = c.select("book_id", "conv_id", "turn", F.explode(F.when(F.col("line").isNull(), own).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("line").alias("text"))), own))).alias("x")).select("*", "x.k", "x.text")
    w = Window.partitionBy("book_id").orderBy("conv_id", "turn", "k")
    c = c.withColumn("para_no", (F.row_number().over(w) - 1).cast("int"))
    runs = F.array(F.struct(F.substring("text", 1, 3).alias("text"), F.lit(True).alias("italic"), F.lit(False).alias("bold")), F.struct(F.expr("substring(text, 4)").alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold")))
    heading = F.expr("CASE WHEN book_id % 2 = 1 AND turn = 0 AND k = 1 AND conv_id % 5 = 0 THEN 1 + conv_id % 2 END").cast("int")
    return c.select("book_id", "para_no", heading.alias("heading"), F.expr("conv_id % 6 = 0 AND turn = 3").alias("centered"), runs.alias("runs"), "text")


#: What event event_id says as a reviewer's action.
ACTION = "CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' WHEN 'error' THEN 'back' WHEN 'signup' THEN CASE WHEN event_id % 40 = 0 THEN 'all' WHEN event_id % 40 = 1 THEN 'none' ELSE 'yes' END ELSE CASE WHEN event_id % 3 = 0 THEN 'back' ELSE 'pause' END END"


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the log of a review: book_id, seq, action."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("book_id"), F.struct("ts", "event_id").alias("seq"), F.expr(ACTION).alias("action"))


def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked about a user's book: its purchases of some value, in order."""
    w = Window.partitionBy("book_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 20").withColumnRenamed("user_id", "book_id")
    return e.select("book_id", (F.row_number().over(w) - 1).alias("place"), F.expr("'e:' || event_id").alias("id"))


def hostile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text files, some of which nest deeper than any reader goes or are of no kind that is read."""
    f = files(spark, sf_dir)
    name = F.expr("CASE WHEN book_id % 13 = 0 THEN 'book-' || book_id || '.pdf' ELSE file_name END")
    return f.withColumn("file_name", name).withColumn("content", F.expr("CASE WHEN book_id % 11 = 0 THEN repeat('>', 1500) || ' ' || content ELSE content END"))
