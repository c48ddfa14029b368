"""Outlines into books: title, parts, chapters. An outline has book_id, item_no, kind ('heading',
'paragraph' or 'scene-break'), depth, text, runs; one block a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def _w(keys):
    return Window.partitionBy(*keys).orderBy("item_no")


def shapes(outline: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, for each outline: title_no and book_title (a heading that opens it, alone at its
    depth, with others below it), and two readings, titled (without the title) and plain (with it):
    d0 and d1 (the two smallest depths), part_shaped (there are two sections at d0 at least, each
    with a heading of depth d1 and one with two), part_depth, chapter_depth.

    One grouping, whose partial results hold the headings only; no row is sorted or windowed."""
    head = F.when(F.col("depth").isNotNull(), F.struct("item_no", "depth"))
    g = outline.groupBy(*keys).agg(
        F.array_sort(F.collect_list(head)).alias("heads"),
        F.min("item_no").alias("first_no"),
        F.min_by("text", F.when(F.col("depth").isNotNull(), F.col("item_no"))).alias("first_text"),
    )
    depths = F.col("heads.depth")
    low = F.array_min(depths)
    opens = (F.get("heads", F.lit(0))["item_no"] == F.col("first_no")) & (F.get(depths, F.lit(0)) == low)
    g = g.withColumn("_titled", F.coalesce(opens & (F.size("heads") >= 2) & (F.size(F.filter(depths, lambda d: d == F.array_min(F.col("heads.depth")))) == 1), F.lit(False)))
    g = g.withColumn("_plain", depths).withColumn("_left", F.when(F.col("_titled"), F.slice(depths, F.lit(2), F.size("heads"))).otherwise(depths))
    out = [*keys, F.when(F.col("_titled"), F.col("first_no")).alias("title_no"), F.when(F.col("_titled"), F.col("first_text")).alias("book_title")]
    return g.withColumn("titled", shape_of(F.col("_left"))).withColumn("plain", shape_of(F.col("_plain"))).select(*out, "titled", "plain")


def shape_of(depths: Column) -> Column:
    """d0, d1, part_shaped, part_depth, chapter_depth of the headings' depths in order: one fold,
    whose state is the number of sections, the count in the present one, and the least and greatest
    count of those that are closed."""

    def by(levels: Column) -> Column:
        d0, d1, depths = levels["d0"], levels["d1"], levels["depths"]
        state = lambda n, now, low, high: F.struct(n.alias("n"), now.alias("now"), low.alias("low"), high.alias("high"))
        closed = lambda s: (F.when(s["n"] > 0, F.least(s["low"], s["now"])).otherwise(s["low"]), F.when(s["n"] > 0, F.greatest(s["high"], s["now"])).otherwise(s["high"]))
        start = state(F.lit(0), F.lit(0), F.lit(2**31 - 1), F.lit(0))
        step = lambda s, d: F.when(d == d0, state(s["n"] + 1, F.lit(0), *closed(s))).when(d == d1, state(s["n"], s["now"] + 1, s["low"], s["high"])).otherwise(s)
        done = lambda s: F.coalesce(d1.isNotNull() & (s["n"] >= 2) & (closed(s)[0] >= 1) & (closed(s)[1] >= 2), F.lit(False))
        shaped = F.aggregate(depths, start, step, done)
        return F.struct(d0.alias("d0"), d1.alias("d1"), shaped.alias("part_shaped"))

    low = F.array_min(depths)
    second = F.array_min(F.filter(depths, lambda d: d > F.array_min(depths)))
    # bound once: what is bound here is a lambda's variable in `by`, not computed again by each step
    found = F.element_at(F.transform(F.array(F.struct(low.alias("d0"), second.alias("d1"), depths.alias("depths"))), by), 1)
    full = lambda x: F.struct(x["d0"].alias("d0"), x["d1"].alias("d1"), x["part_shaped"].alias("part_shaped"), F.when(x["part_shaped"], x["d0"]).alias("part_depth"), F.when(x["part_shaped"], x["d1"]).otherwise(x["d0"]).alias("chapter_depth"))
    return F.element_at(F.transform(F.array(found), full), 1)


def segments(outline: DataFrame, keys: list[str], detect: bool = True, by_file: Column | None = None) -> DataFrame:
    """The outline without its title row, with seg, part, is_part, is_chapter, chapter_no (of the
    segments with a title or a block; null in others), book_title, and demoted: headings below
    chapters become bold paragraphs. by_file: where it holds, a lone heading over one chapter is no
    title but that chapter's.

    All windows have one partitioning and one order; both readings are computed in the same pass."""
    o = outline.join(shapes(outline, keys), keys)
    w, run = Window.partitionBy(*keys), _w(keys)
    is_title = (F.col("item_no") == F.col("title_no")) if detect else F.lit(False)
    o = o.withColumn("is_title", F.coalesce(is_title, F.lit(False)))
    readings = ["titled", "plain"] if by_file is not None else ["titled" if detect else "plain"]
    for r in readings:
        live = ~F.col("is_title") if r == "titled" else F.lit(True)
        for role in ("part", "chapter"):
            o = o.withColumn(f"{r}_{role}", F.coalesce(live & (F.col("depth") == F.col(r)[f"{role}_depth"]), F.lit(False)))
        o = o.withColumn(f"{r}_mark", live & ~F.col(f"{r}_part"))  # rows that make their segment a chapter
    sums = {f"{r}_seg": F.sum((F.col(f"{r}_part") | F.col(f"{r}_chapter")).cast("int")).over(run) for r in readings}
    sums |= {f"{r}_name": F.last(F.when(F.col(f"{r}_part"), F.col("text")), ignorenulls=True).over(run) for r in readings}
    o = o.withColumns(sums)
    if by_file is not None:
        marked = F.when(F.col("titled_mark"), F.col("titled_seg"))
        lone = F.coalesce(by_file & F.col("book_title").isNotNull() & (F.min(marked).over(w) == F.max(marked).over(w)), F.lit(False))
        o = o.withColumn("_lone", lone)
        pick = lambda c: F.when(F.col("_lone"), F.col(f"plain_{c}")).otherwise(F.col(f"titled_{c}"))
        o = o.withColumn("is_title", F.col("is_title") & ~F.col("_lone")).withColumn("book_title", F.when(~F.col("_lone"), F.col("book_title")))
    else:
        pick = lambda c: F.col(f"{readings[0]}_{c}")
        o = o if detect else o.withColumn("book_title", F.lit(None).cast("string"))
    o = o.withColumns({"seg": pick("seg"), "part": pick("name"), "is_part": pick("part"), "is_chapter": pick("chapter"), "_mark": pick("mark")})
    before = F.last(F.when(F.col("_mark"), F.col("seg")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("_new", F.col("_mark") & ~F.col("seg").eqNullSafe(before))
    o = o.withColumn("chapter_no", F.when(F.col("_mark"), F.sum(F.col("_new").cast("int")).over(run) - 1).cast("int"))
    return demoted(o.where("not is_title")).select(*outline.columns, "seg", "part", "is_part", "is_chapter", "chapter_no", "book_title", "demoted")


def demoted(rows: DataFrame) -> DataFrame:
    """Adds demoted: headings that are neither parts nor chapters, which become bold paragraphs."""
    deep = (F.col("kind") == "heading") & ~F.col("is_part") & ~F.col("is_chapter")
    bold = F.array(F.struct(F.col("text"), F.lit(False).alias("italic"), F.lit(True).alias("bold")))
    o = rows.withColumn("runs", F.when(deep, bold).otherwise(F.col("runs"))).withColumn("demoted", deep)
    return o.withColumn("kind", F.when(deep, "paragraph").otherwise(F.col("kind")))


def chapters(segmented: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, seg, chapter_no, title, part, n_blocks: segments with a title or a block; and the
    columns named in carry, which are the same in all rows of an outline."""
    return segmented.where("chapter_no is not null").groupBy(*keys, "chapter_no").agg(
        F.max("seg").alias("seg"),
        F.coalesce(F.max(F.when(F.col("is_chapter"), F.col("text"))), F.lit("")).alias("title"),
        F.max("part").alias("part"),
        F.sum((~F.col("is_chapter")).cast("int")).alias("n_blocks"),
        *[F.max(c).alias(c) for c in carry],
    )


def blocks(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chapter_no, block_no, kind, runs, text, demoted. The rows know their chapters."""
    body = segmented.where("chapter_no is not null and not is_chapter")
    w = Window.partitionBy(*keys, "chapter_no").orderBy("item_no")
    body = body.withColumn("block_no", (F.row_number().over(w) - 1).cast("int"))
    return body.select(*keys, "chapter_no", "block_no", "kind", "runs", "text", "demoted")


def with_empty_books(found: DataFrame, books: DataFrame) -> DataFrame:
    """Books without a chapter get one untitled, empty chapter."""
    return books.select("book_id").join(found, "book_id", "left").select("book_id", F.coalesce("chapter_no", F.lit(0)).alias("chapter_no"), F.coalesce("title", F.lit("")).alias("title"), "part", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def paragraph_outline(paras: DataFrame) -> DataFrame:
    """From paragraphs: scene breaks first, then blank ones dropped, then headings and body."""
    p = paras.withColumn("raw", T.run_text(F.col("runs")))
    scene = T.is_scene_break(F.col("raw"))
    kind = F.when(scene, "scene-break").when(F.col("heading").isNotNull(), "heading").otherwise("paragraph")
    p = p.withColumn("kind", kind).where(scene | (T.trim(F.col("raw")) != ""))
    return p.select("book_id", F.col("para_no").alias("item_no"), "kind", F.when(F.col("kind") == "heading", F.col("heading")).alias("depth"), F.when(F.col("kind") == "heading", T.trim(F.col("raw"))).otherwise(F.col("raw")).alias("text"), F.when(F.col("kind") == "paragraph", F.col("runs")).alias("runs"))


def line_outline(paras: DataFrame) -> DataFrame:
    """For books without headings: lines that read as chapter titles count as headings of depth 1."""
    p = paras.withColumn("raw", T.run_text(F.col("runs")))
    line, scene = T.is_chapter_line(F.col("raw")), T.is_scene_break(F.col("raw"))
    kind = F.when(line, "heading").when(scene, "scene-break").otherwise("paragraph")
    p = p.withColumn("kind", kind).where(line | scene | (T.trim(F.col("raw")) != ""))
    return p.select("book_id", F.col("para_no").alias("item_no"), "kind", F.when(F.col("kind") == "heading", 1).alias("depth"), F.when(F.col("kind") == "heading", T.trim(F.col("raw"))).otherwise(F.col("raw")).alias("text"), F.when(F.col("kind") == "paragraph", F.col("runs")).alias("runs"))


def part_starts(found: DataFrame) -> DataFrame:
    """Adds new_part_web (against the chapter before) and new_part_print (against the last part
    that was printed, through chapters without one)."""
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    named = F.nullif(F.col("part"), F.lit(""))
    before = F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("new_part_web", named.isNotNull() & ~F.col("part").eqNullSafe(F.lag("part").over(w))).withColumn("new_part_print", named.isNotNull() & ~named.eqNullSafe(before))


def first_paragraphs(rows: DataFrame) -> DataFrame:
    """Adds is_first: the first paragraph of a chapter or after a scene break."""
    w = Window.partitionBy("book_id", "chapter_no").orderBy("block_no")
    return rows.withColumn("is_first", (F.col("kind") == "paragraph") & F.coalesce(F.lag("kind").over(w) == "scene-break", F.lit(True)))
