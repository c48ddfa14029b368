"""Books larger than a task: running values over ranges of a book's rows, with what is carried over.

A running value over a whole book is cut at fixed numbers of rows, so that a book is as many window
partitions as it has ranges. Each range is summed up in one row - how many segments begin in it, its
last part, the sum and the least running sum of a counter - and only these rows are scanned in order
of the book: 10^7 items are a hundred of them at `WIDTH`. What comes before a range is then joined
to its rows. The results are those of one window over the book (`outline.segments`, `html.styles`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import outline as O

WIDTH = 100_000


def _ranged(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_range", F.floor(F.col(order) / width))


def _before(sums: DataFrame, keys: list[str], **carried: Column) -> DataFrame:
    """keys, _range and the carried values of all ranges before it."""
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_range", *[c.over(w).alias(name) for name, c in carried.items()])


def segments(outline: DataFrame, keys: list[str], detect: bool = True, width: int = WIDTH) -> DataFrame:
    """What `outline.segments` gives, for books of any number of items. The outlines' shapes come from
    one grouping, of which a book's headings are in one task; its rows never are."""
    reading = "titled" if detect else "plain"
    o = _ranged(outline.join(O.shapes(outline, keys), keys), "item_no", width)
    is_title = F.coalesce(F.col("item_no") == F.col("title_no"), F.lit(False)) if detect else F.lit(False)
    o = o.withColumn("is_title", is_title)
    for role in ("part", "chapter"):
        o = o.withColumn(f"is_{role}", F.coalesce(~F.col("is_title") & (F.col("depth") == F.col(reading)[f"{role}_depth"]), F.lit(False)))
    o = o.withColumn("_mark", ~F.col("is_title") & ~F.col("is_part")).withColumn("_starts", (F.col("is_part") | F.col("is_chapter")).cast("int"))
    cells = [*keys, "_range"]
    run = Window.partitionBy(*cells).orderBy("item_no")
    part = F.when(F.col("is_part"), F.col("text"))
    o = o.withColumns({"_seg": F.sum("_starts").over(run), "_part": F.last(part, ignorenulls=True).over(run)})

    marked = F.when(F.col("_mark"), F.col("_seg"))
    sums = o.groupBy(*cells).agg(
        F.sum("_starts").alias("starts"),
        F.max_by("text", F.when(F.col("is_part"), F.col("item_no"))).alias("last_part"),
        F.min(marked).alias("first_mark"),
        F.max(marked).alias("last_mark"),
        F.count_distinct(marked).alias("marks"),
    )
    base = _before(sums, keys, base=F.sum("starts"), part_before=F.last("last_part", ignorenulls=True))
    sums = sums.join(base, cells).withColumns({"base": F.coalesce("base", F.lit(0))})
    # a range's first marked segment may be the one that was open before it: then it is no new chapter
    seen = _before(sums.withColumn("_last", F.col("base") + F.col("last_mark")), keys, open=F.last("_last", ignorenulls=True))
    sums = sums.join(seen, cells).withColumn("same", F.coalesce((F.col("base") + F.col("first_mark") == F.col("open")).cast("int"), F.lit(0)))
    chapters = _before(sums, keys, chapters_before=F.sum(F.col("marks") - F.col("same")))
    sums = sums.join(chapters, cells).select(*cells, "base", "part_before", "same", F.coalesce("chapters_before", F.lit(0)).alias("chapters_before"))

    o = o.join(sums, cells)
    before = F.last(marked, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("_new", F.col("_mark") & ~F.col("_seg").eqNullSafe(before))
    local = F.sum(F.col("_new").cast("int")).over(run)
    o = o.withColumn("chapter_no", F.when(F.col("_mark"), F.col("chapters_before") + local - F.col("same") - 1).cast("int"))
    o = o.withColumns({"seg": F.col("base") + F.col("_seg"), "part": F.coalesce("_part", "part_before")})
    return O.demoted(o.where("not is_title")).select(*outline.columns, "seg", "part", "is_part", "is_chapter", "chapter_no", F.col("book_title") if detect else F.lit(None).cast("string").alias("book_title"), "demoted")


def clamped(rows: DataFrame, keys: list[str], order: str, steps: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Adds, for each name in steps, the running sum of its steps that is never below zero: the sum
    less the least (or zero) that it has had. Pairs of sum and least sum of ranges are what combines."""
    o = _ranged(rows, order, width)
    cells = [*keys, "_range"]
    run = Window.partitionBy(*cells).orderBy(order)
    o = o.withColumns({f"_sum_{n}": F.sum(c).over(run) for n, c in steps.items()})
    o = o.withColumns({f"_low_{n}": F.min(f"_sum_{n}").over(run) for n in steps})
    sums = o.groupBy(*cells).agg(*[x for n in steps for x in (F.max_by(f"_sum_{n}", order).alias(f"_all_{n}"), F.min(f"_sum_{n}").alias(f"_least_{n}"))])
    base = _before(sums, keys, **{f"_base_{n}": F.sum(f"_all_{n}") for n in steps})
    sums = sums.join(base, cells).withColumns({f"_base_{n}": F.coalesce(f"_base_{n}", F.lit(0)) for n in steps})
    low = _before(sums, keys, **{f"_lowest_{n}": F.min(F.col(f"_base_{n}") + F.col(f"_least_{n}")) for n in steps})
    sums = sums.select(*cells, *[f"_base_{n}" for n in steps]).join(low, cells)
    o = o.join(sums, cells)
    for n in steps:
        total = F.col(f"_base_{n}") + F.col(f"_sum_{n}")
        least = F.least(F.lit(0), F.coalesce(f"_lowest_{n}", F.lit(0)), F.col(f"_base_{n}") + F.col(f"_low_{n}"))
        o = o.withColumn(n, (total - least).cast("int"))
    return o.select(*rows.columns, *steps)
