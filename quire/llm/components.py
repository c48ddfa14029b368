"""Connected components of a link table, by alternating large and small stars.

Links are first contracted within partitions to spanning forests. Each round then hangs every
node on the smallest node it knows; the link table never grows and nothing of it reaches the
driver but a checksum. A hub may hold a third of all links: its minimum is pre-aggregated, and
the join that follows is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches


class Forest:
    """Union by smallest index over 0..n-1; label[i] is the smallest index known to reach i."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if not (low != high).any():
                return
            np.minimum.at(self.label, high, low)
            while not (self.label == (up := self.label[self.label])).all():
                self.label = up


def contract(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the links, of at most `limit` links at a time."""

    def flush() -> pa.RecordBatch:
        a, b = np.concatenate(held[0]), np.concatenate(held[1])
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(at[: len(a)], at[len(a) :])
        keep = forest.label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[forest.label[keep]])], names=["a", "b"])

    held: tuple[list, list] = ([], [])
    n = 0
    for batch in batches:
        for h, c in zip(held, ("a", "b"), strict=True):
            h.append(batch.column(c).to_numpy())
        n += batch.num_rows
        if n >= limit:  # the stars so far stay in hand, so that all that a task sees hangs together
            flushed = flush()
            held, n = ([flushed.column("a").to_numpy()], [flushed.column("b").to_numpy()]), flushed.num_rows
            if 2 * n > limit:
                yield flushed
                held, n = ([], []), 0
    if n:
        yield flush()


def with_least(rows: DataFrame, low: DataFrame, links: int, most: int = 50_000) -> DataFrame:
    """Adds m, the smallest neighbour of a, from low (a, m, n: its number of neighbours). Nodes of
    over links / most neighbours are fewer than `most`, so they are broadcast, and a hub's rows
    stay where they are; all other nodes are joined by key."""
    limit = max(links // most, 256)
    hubs = F.broadcast(low.where(F.col("n") > limit).select("a", F.col("m").alias("hub_m")))
    marked = rows.join(hubs, "a", "left")
    rest = marked.where("hub_m is null").drop("hub_m").join(low.where(F.col("n") <= limit).select("a", "m"), "a")
    return marked.where("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


def connected_components(links: DataFrame, contracted: bool = False, rounds: int = 60) -> DataFrame:
    """links: a, b (long, never null). Returns node, root for every node with a link to another
    one; root is the smallest node of the component. No links give no rows. contracted: the links
    are spanning stars of their partitions (what `contract` yields) already."""
    links = links.where("a != b").select("a", "b")
    stars = cut_lineage((links if contracted else map_batches(links, contract, "a long, b long")).distinct())  # a > b
    seen, n = None, stars.count()
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both.where("b > a"), low, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, 2 * n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        stars = cut_lineage(small.where("a != b").distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_nodes(classes: DataFrame, rep: str = "rep") -> tuple[DataFrame, int]:
    """Classes whose name, the smallest id of their rows, is null get a number above all ids, which
    is returned: components of such numbers only have no name. Ids are taken to be below 2**62."""
    top, nulls = classes.agg(F.max(rep), F.count_if(F.col(rep).isNull())).first()
    top = max(top or 0, 0)
    if nulls:
        classes = cut_lineage(classes.withColumn(rep, F.coalesce(rep, F.monotonically_increasing_id() + F.lit(top + 1))))
    return classes, top


def in_cells(rows: DataFrame, keys: list[str], key_id: str, limit: int) -> DataFrame:
    """Splits groups of over `limit` rows: adds part, cell_i, cell_j. A group of n rows becomes
    parts, and each pair of parts a cell of its own; every pair of rows meets in one cell (rows
    of one part in the cell i = j). Other groups stay one cell."""
    hot = cut_lineage(rows.groupBy(*keys).count().where(F.col("count") > limit))
    if hot.count() <= 50_000:  # the bound of what is broadcast
        hot = F.broadcast(hot)
    parts = F.coalesce(F.ceil(F.col("count") / limit), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(key_id), parts).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("cell_i", F.least("part", "other")).withColumn("cell_j", F.greatest("part", "other")).drop("count", "other")


def group_runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows that lie together by integer keys: tables of whole groups, with the first row of
    each group. Groups are small here (see in_cells), so a table holds about `limit` rows."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
                rest = table.slice(at[-1])
                held, n = rest.to_batches(), rest.num_rows
            else:
                limit = 2 * n
                held = table.to_batches()
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)
