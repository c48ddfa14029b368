"""Paragraphs of simple HTML, in DataFrame operators: tokens, clamped style counters, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

CENTERED = "is-centered"


def tokens(docs: DataFrame) -> DataFrame:
    """book_id, tok_no, token: tags and the text between; empty tokens are left out, numbers stay."""
    split = F.split(F.regexp_replace("html", "(<[^>]+>)", "\u0000$1\u0000"), "\u0000")
    return docs.select("book_id", F.posexplode(split).alias("tok_no", "token")).where("token <> ''")


def tags(rows: DataFrame, centered: str = CENTERED) -> DataFrame:
    """Adds closing, tag, depth (h1-h6), is_text, is_center."""
    pattern = rf"\A<[{T.WS}]*(/?)[{T.WS}]*([a-zA-Z0-9]+)"
    rows = rows.withColumn("is_text", ~F.col("token").startswith("<"))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("token", pattern, 2))).withColumn("closing", F.regexp_extract("token", pattern, 1) == "/")
    rows = rows.withColumn("depth", F.when(F.col("tag").rlike(r"\Ah[1-6]\z"), F.substring("tag", 2, 1).cast("int")))
    return rows.withColumn("is_center", F.col("tag").isin("p", "li") & F.col("token").rlike(rf'class="[^"]*\b{centered}\b'))


def style_steps() -> dict[str, Column]:
    """What a token adds to the open tags of italic and bold."""
    step = lambda *kinds: F.when(F.col("tag").isin(*kinds) & ~F.col("is_text"), F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    return {"italic": step("em", "i"), "bold": step("strong", "b")}


def styles(rows: DataFrame) -> DataFrame:
    """Adds italic and bold: open tags of each, never below zero, over the whole document. For
    documents larger than a task see `ranges.clamped`."""
    w = Window.partitionBy("book_id").orderBy("tok_no")
    rows = rows.withColumns({f"_{n}": F.sum(c).over(w) for n, c in style_steps().items()})
    rows = rows.withColumns({n: (F.col(f"_{n}") - F.least(F.lit(0), F.min(f"_{n}").over(w))).cast("int") for n in ("italic", "bold")})
    return rows.drop("_italic", "_bold")


def pieces(rows: DataFrame) -> DataFrame:
    """Text in open paragraphs: book_id, seg, tok_no, heading, centered, text, italic, bold."""
    w = Window.partitionBy("book_id").orderBy("tok_no")
    edge = ~F.col("is_text") & (F.col("depth").isNotNull() | F.col("tag").isin("p", "li"))
    rows = rows.withColumn("edge", edge).withColumn("seg", F.sum(F.col("edge").cast("int")).over(w))
    start = F.when(F.col("edge"), F.struct(F.col("closing").alias("closing"), F.col("depth").alias("heading"), F.col("is_center").alias("centered")))
    rows = rows.withColumn("start", F.last(start, ignorenulls=True).over(w)).where("start is not null and not start.closing")
    text = F.when(F.col("is_text"), T.decode_entities(F.col("token"))).when(F.col("tag") == "br", F.lit(" "))
    rows = rows.withColumn("text", text).where("text <> ''")
    return rows.select("book_id", "seg", "tok_no", "start.heading", "start.centered", "text", (F.col("italic") > 0).alias("italic"), (F.col("bold") > 0).alias("bold"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """book_id, para_no, heading, centered, runs of each paragraph that isn't blank."""
    runs = F.array_sort(F.collect_list(F.struct("tok_no", "text", "italic", "bold")))
    p = pieces(styles(tags(tokens(docs)))).groupBy("book_id", "seg").agg(F.first("heading").alias("heading"), F.first("centered").alias("centered"), runs.alias("runs"))
    p = p.withColumn("runs", T.merge_runs(F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["italic"].alias("italic"), r["bold"].alias("bold")))))
    p = p.where(T.trim(T.run_text(F.col("runs"))) != "")
    w = Window.partitionBy("book_id").orderBy("seg")
    return p.select("book_id", (F.row_number().over(w) - 1).alias("para_no"), "heading", "centered", "runs")
