"""Reviews of candidates: the log of what a reviewer did becomes one answer for each candidate.

A review walks the candidates of a book in order. 'yes' and 'no' answer the present one and go on,
'back' returns to the one before, 'all' and 'none' answer the present one and all after it, which
ends the review, as the answer to the last one does. What comes after the end counts for nothing.

The place before each action is not found by walking: yes and no are steps of +1, back is one of -1
that stops at the first candidate, and a clamped sum is the running sum less the least (or zero)
that it has had. Both are running aggregates over one sort of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("yes", "no", "back", "all", "none")


def positions(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """log (book_id, seq, action) with place (of the candidate that was shown, from 0), ends (the
    review ends with it) and live (it comes no later than the end). sizes: book_id, n (candidates).
    Unknown actions change nothing and stay out, as the log of a book without candidates does."""
    run = Window.partitionBy("book_id").orderBy("seq")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("action") == "back", -1).otherwise(1)
    acted = log.where(F.col("action").isin(*ACTIONS)).join(sizes.where("n > 0").select("book_id", "n"), "book_id")
    walked = acted.withColumn("_sum", F.sum(step).over(run))
    zero = lambda c: F.coalesce(c, F.lit(0))
    walked = walked.withColumn("place", zero(F.lag("_sum").over(run)) - F.least(F.lit(0), zero(F.min("_sum").over(before))))
    ends = F.col("action").isin("all", "none") | (F.col("action").isin("yes", "no") & (F.col("place") >= F.col("n") - 1))
    walked = walked.withColumn("ends", ends)
    return walked.withColumn("live", ~F.coalesce(F.max("ends").over(before), F.lit(False))).drop("_sum", "n")


def reduce_answers(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (book_id, place, ...; places from 0 without gaps) with is_title, the answer that
    holds (null: none), and finished (the review of the book ended). The last answer to a candidate
    holds; 'all' and 'none' overwrite what was given to later candidates before the reviewer went
    back. One row a book and one an answered candidate are joined to the candidates."""
    sizes = candidates.groupBy("book_id").agg(F.count("*").alias("n"))
    live = positions(log, sizes).where("live")
    yes = F.col("action").isin("yes", "all")
    answers = live.where("action in ('yes', 'no')").groupBy("book_id", "place").agg(F.max_by(yes, "seq").alias("_own"))
    rest = live.groupBy("book_id").agg(F.bool_or("ends").alias("_ends"), F.min(F.when(F.col("action").isin("all", "none"), F.struct("place", yes.alias("yes")))).alias("_rest"))
    joined = candidates.join(answers, ["book_id", "place"], "left").join(rest, "book_id", "left")
    bulk = F.when(F.col("place") >= F.col("_rest.place"), F.col("_rest.yes"))
    return joined.withColumn("is_title", F.coalesce(bulk, F.col("_own"))).withColumn("finished", F.coalesce("_ends", F.lit(False))).drop("_own", "_rest", "_ends")


def decisions_of(answered: DataFrame) -> DataFrame:
    """book_id, id, is_title of finished reviews: an unfinished one decides nothing."""
    return answered.where("finished and is_title is not null").select("book_id", "id", "is_title")
