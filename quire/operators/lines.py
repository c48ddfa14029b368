"""Lines of plain text: headings, hand-centered titles, and reviewers' answers about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

KEYS = ["book_id", "file_ord"]


def lines(files: DataFrame) -> DataFrame:
    """book_id, file_ord, line_no, line: one row a line, empty lines and carriage returns kept."""
    return files.select(*KEYS, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def headings(rows: DataFrame) -> DataFrame:
    return rows.withColumn("depth", T.atx_depth(F.col("line"))).where("depth is not null")


def plausible(rows: DataFrame, found: Column, population: Column, keys: list[str]) -> DataFrame:
    """Keeps what is found unless that is over 20 and over a fifth of the population."""
    w = Window.partitionBy(*keys)
    n, of = F.sum(found.cast("int")).over(w), F.sum(population.cast("int")).over(w)
    return rows.withColumn("_found", found).withColumn("_many", (n > 20) & (n * 5 > of)).where("_found and not _many").drop("_found", "_many")


def centered_lines(rows: DataFrame, check: bool = True) -> DataFrame:
    """book_id, file_ord, idx, text, before, after: lines that stand alone and look centered, with the
    nearest text on both sides. check: drop all of a file if they are implausibly many. Only lines
    with text are sorted: their neighbours are the nearest text, and gaps in their numbers are the
    empty lines."""
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    t = rows.withColumn("text", T.trim(F.col("line"))).where("text <> ''")
    t = t.withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w), "_prev": F.lag("line_no").over(w), "_next": F.lead("line_no").over(w)})
    alone = F.coalesce(F.col("line_no") - F.col("_prev") > 1, F.lit(True)) & F.coalesce(F.col("_next") - F.col("line_no") > 1, F.lit(True))
    found = alone & T.is_centered_shaped(F.col("line"))
    t = plausible(t, found, F.lit(True), KEYS) if check else t.where(found)
    return t.select(*KEYS, F.col("line_no").alias("idx"), "text", T.clip(F.col("before")).alias("before"), T.clip(F.col("after")).alias("after"))


def centered_paragraphs(paras: DataFrame) -> DataFrame:
    """The same for paragraphs (book_id, para_no, heading, centered, runs): body paragraphs that are
    centered by white space or alignment, with their immediate neighbours."""
    w = Window.partitionBy("book_id").orderBy("para_no")
    p = paras.withColumn("raw", T.run_text(F.col("runs"))).withColumn("text", T.trim(F.col("raw")))
    p = p.withColumn("before", T.clip(F.lag("text").over(w))).withColumn("after", T.clip(F.lead("text").over(w)))
    found = F.col("heading").isNull() & (T.is_centered_shaped(F.col("raw")) | (F.coalesce("centered", F.lit(False)) & T.is_title_shaped(F.col("text"))))
    return plausible(p, found, F.lit(True), ["book_id"]).select("book_id", F.col("para_no").alias("idx"), "text", "before", "after")


def with_ids(candidates: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds id: <file name>:<line>, or docx:<paragraph>."""
    if files is None:
        return candidates.withColumn("id", F.concat(F.lit("docx:"), "idx"))
    return candidates.join(files.select(*KEYS, "file_name"), KEYS).withColumn("id", F.concat_ws(":", "file_name", "idx"))


def answered(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds is_title from decisions (book_id, id, is_title); null where nobody answered."""
    return candidates.join(decisions.select("book_id", "id", "is_title"), ["book_id", "id"], "left")


def bulk_answer(candidates: DataFrame, rest: bool, order: list[str]) -> DataFrame:
    """Fills answers from the first unanswered candidate on with one for all."""
    w = Window.partitionBy("book_id").orderBy(*order)
    return candidates.withColumn("is_title", F.coalesce("is_title", F.when(F.max(F.col("is_title").isNull()).over(w), F.lit(rest))))


def promotion_depth(depths: DataFrame, first_is_heading: DataFrame | None = None) -> DataFrame:
    """From book_id, file_ord, depth, ord (and whether the file opens with a heading): the depth that
    a confirmed title gets."""
    g = depths.groupBy(*KEYS).agg(F.min("depth").alias("low"), F.min_by("depth", "ord").alias("first"), F.collect_list("depth").alias("all"))
    g = g.withColumn("alone", F.size(F.filter("all", lambda d: d == F.col("low"))) == 1)
    if first_is_heading is not None:
        g = first_is_heading.join(g, KEYS, "left")
    lone = F.coalesce(F.col("opens") & F.col("alone") & (F.col("first") == F.col("low")), F.lit(False))
    return g.select(*KEYS, F.when(F.col("low").isNull(), 1).when(lone, F.least(F.col("low") + 1, F.lit(6))).otherwise(F.col("low")).cast("int").alias("depth"))


def opens_with_heading(rows: DataFrame) -> DataFrame:
    """book_id, file_ord, opens: is the first content after blank lines and front matter a heading?"""
    w = Window.partitionBy(*KEYS)
    t = rows.withColumn("text", T.trim(F.col("line")))
    first = F.min(F.when(F.col("text") != "", F.col("line_no"))).over(w)
    t = t.withColumn("first", first)
    fence = F.min(F.when((F.col("text") == "---") & (F.col("line_no") == F.col("first")), F.col("line_no"))).over(w)
    t = t.withColumn("fence", fence)
    t = t.withColumn("closed", F.min(F.when((F.col("text") == "---") & (F.col("line_no") > F.col("fence")), F.col("line_no"))).over(w))
    start = F.when(F.col("fence").isNull(), F.col("first")).otherwise(F.coalesce(F.col("closed") + 1, F.lit(1 << 30)))
    content = (F.col("text") != "") & (F.col("line_no") >= start)
    return t.groupBy(*KEYS).agg(F.coalesce(F.min_by(T.atx_depth(F.col("line")).isNotNull(), F.when(content, F.col("line_no"))), F.lit(False)).alias("opens"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value as a lambda's variable, so that it is computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def review(files: DataFrame, check: bool = True) -> DataFrame:
    """files (book_id, file_ord, file_name, content) with candidates (array of idx, text, before,
    after, as `centered_lines` finds them) and depth (what a confirmed title gets, as
    `promotion_depth`). A file is one row all along: no line is exploded, sorted or shuffled."""
    at = lambda array, i: F.get(array, i)

    def candidates(lines: Column, texts: Column, full: Column) -> Column:
        near = F.transform(full, lambda i, k: F.struct(i.alias("idx"), at(full, k - 1).alias("prev"), at(full, k + 1).alias("next")))
        apart = lambda gap: F.coalesce(gap > 1, F.lit(True))
        found = F.filter(near, lambda r: apart(r["idx"] - r["prev"]) & apart(r["next"] - r["idx"]) & T.is_centered_shaped(at(lines, r["idx"])))
        made = lambda r: F.struct(r["idx"].alias("idx"), at(texts, r["idx"]).alias("text"), T.clip(at(texts, r["prev"])).alias("before"), T.clip(at(texts, r["next"])).alias("after"))
        many = lambda f: (F.size(f) > 20) & (F.size(f) * 5 > F.size(full)) if check else F.lit(False)
        return bound(found, lambda f: F.transform(F.filter(f, lambda _: ~many(f)), made))

    def depth(lines: Column, texts: Column, full: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x: T.atx_depth(x)), lambda d: d.isNotNull())
        first = at(full, F.lit(0))
        closed = F.array_min(F.filter(full, lambda i: (i > first) & (at(texts, i) == "---")))
        content = F.when(at(texts, first) == "---", F.array_min(F.filter(full, lambda i: i > closed))).otherwise(first)
        opens = F.coalesce(T.atx_depth(at(lines, content)).isNotNull(), F.lit(False))

        def of(h: Column) -> Column:
            low = F.array_min(h)
            lone = opens & (at(h, F.lit(0)) == low) & (F.size(F.filter(h, lambda d: d == F.array_min(h))) == 1)
            return F.when(F.size(h) == 0, 1).when(lone, F.least(low + 1, F.lit(6))).otherwise(low)

        return bound(heads, of).cast("int")

    def facts(lines: Column) -> Column:
        def of(texts: Column) -> Column:
            full = F.filter(F.transform(texts, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
            return bound(full, lambda f: F.struct(candidates(lines, texts, f).alias("candidates"), depth(lines, texts, f).alias("depth")))

        return bound(F.transform(lines, lambda x: T.trim(x)), of)

    found = bound(F.split(F.coalesce("content", F.lit("")), "\n"), facts)
    return files.withColumn("_facts", found).select(*files.columns, "_facts.candidates", "_facts.depth")


def candidate_rows(reviewed: DataFrame) -> DataFrame:
    """book_id, file_ord, file_name, idx, id, text, before, after of what `review` found."""
    rows = reviewed.select(*KEYS, "file_name", F.explode("candidates").alias("c")).select(*KEYS, "file_name", "c.*")
    return rows.withColumn("id", F.concat_ws(":", "file_name", "idx"))


def with_answers(reviewed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds answers (array of no, yes, by line) to what `review` gives: the decisions (book_id, id,
    is_title) about its candidates. Only decisions are grouped; of two about one line the confirming
    one holds, null ones are none."""
    given = decisions.where("is_title is not null").groupBy("book_id", "id").agg(F.bool_or("is_title").alias("yes"))
    given = given.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "yes"))).alias("_given"))
    said = lambda c: F.struct(c["idx"].alias("no"), F.col("_given")[F.concat_ws(":", F.col("file_name"), c["idx"])].alias("yes"))
    answers = F.filter(F.transform("candidates", said), lambda a: a["yes"].isNotNull())
    return reviewed.join(given, "book_id", "left").withColumn("answers", F.when(F.col("_given").isNotNull(), answers)).drop("_given")


def apply_answers(files: DataFrame) -> DataFrame:
    """Files with content, depth and answers (array of no, yes, sorted by no, each line once) become
    files with new content: confirmed lines become headings, declined ones lose their indent. Lines
    between two answers are copied in one piece; answers and depth go."""

    def joined(lines: Column) -> Column:
        after = lambda i: F.coalesce(F.get(F.col("answers"), i)["no"] + 1, F.lit(0))

        def piece(a: Column, i: Column) -> Column:
            text = T.trim(F.get(lines, a["no"]))
            new = F.when(text == "", F.get(lines, a["no"])).when(a["yes"], F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), text)).otherwise(text)
            return F.array_join(F.concat(F.slice(lines, after(i - 1) + 1, a["no"] - after(i - 1)), F.array(new)), "\n")

        start = after(F.size("answers") - 1)
        rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
        pieces = F.transform("answers", piece)
        return F.array_join(F.when(F.size(rest) > 0, F.concat(pieces, F.array(F.array_join(rest, "\n")))).otherwise(pieces), "\n")

    new = bound(F.split("content", "\n"), joined)
    none = F.col("answers").isNull() | (F.size("answers") == 0)
    return files.withColumn("content", F.when(none, F.col("content")).otherwise(new)).drop("answers", "depth")


def apply_decisions(files: DataFrame, decisions: DataFrame, depths: DataFrame) -> DataFrame:
    """The same for answers by line (book_id, file_ord, idx, is_title) and depths of files; null
    answers change nothing, and of two for one line the confirming one holds."""
    sorted_answers = F.array_sort(F.collect_set(F.struct(F.col("idx").cast("int").alias("no"), F.col("is_title").alias("yes"))))
    answers = decisions.where("is_title is not null").groupBy(*KEYS).agg(sorted_answers.alias("answers"))
    last_of_line = F.filter("answers", lambda x, i: ~F.coalesce(F.get(F.col("answers"), i + 1)["no"] == x["no"], F.lit(False)))
    return apply_answers(files.join(answers.withColumn("answers", last_of_line), KEYS, "left").join(depths, KEYS))
