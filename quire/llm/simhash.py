"""SimHash near-duplicates with a Gray-order hierarchical index.

Texts become 64-bit fingerprints (majority bits of the hashes of their shingles). Only distinct
fingerprints are compared. Two that differ in at most r bits agree fully on at least one of r + 1
blocks of bits, so each fingerprint is dealt once for each block, by the block's bits. What a task
gets of one block, it searches as a whole: the fingerprints lie in Gray order, in which neighbours
share long bit patterns; runs of them are nodes that hold the bits all members agree on, upper
nodes the bits their children agree on. Pairs of nodes are followed down from the top: the
differences on the bits that both nodes have settled add up, and a pair with too many, or with any
on the block that has to agree, is dropped with all that is below it, as is a pair whose members
are all connected already. A task yields the links of a spanning forest, never all pairs. A block
value that a great part of all fingerprints share is dealt again by further blocks.

A fingerprint goes by the smallest id that has it, so that the smallest member of a component is
the component's name, and nothing is grouped by component.

Defined results: null and empty texts have fingerprint zero, which links like any other; a null
id keeps its row, and is never a component's name unless all its ids are null; equal texts get
equal results; an empty table gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm._common import cut_lineage, map_batches, slices, texts_of
from quire.llm.components import Forest, connected_components, contract, group_runs, in_cells, named_nodes

LEAF, FAN = 16, 4


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's shingles of `words` words."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not found:
        return 0
    line = b" ".join(found)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    if len(found) < words:
        return xxh64_intdigest(line, seed)
    starts = [0, *[e + 1 for e in ends[: len(found) - words]]]
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        cut = [line[a:b] for a, b in zip(starts[i : i + (1 << 15)], ends[i + words - 1 :], strict=False)]
        h = np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), np.uint64, len(cut))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words, seed) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def agreed_masks(radius: int, levels: int) -> list[int]:
    """Masks of agreed bits (signed), as a tree in heap order: the children of mask k are at
    (radius + 1) * k + 1 and after, each with one more block of the bits that k leaves open."""
    masks, n = [0], radius + 1
    for k in range(sum(n**i for i in range(levels))):
        free = [b for b in range(64) if not masks[k] >> b & 1]
        masks += [masks[k] | sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]
    return [int(np.uint64(m).view(np.int64)) for m in masks]


class GrayIndex:
    """Nodes over fingerprints in Gray order: level 0 has runs of LEAF of them, each level above
    runs of FAN nodes. A node has the mask of bits its members agree on, and their values.
    compared counts the pairs of fingerprints that a search looked at, dropped the pairs of nodes
    it left out with all that is below them."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.compared, self.dropped = fp, 0, 0
        at = np.arange(0, len(fp), LEAF)
        spread = np.bitwise_or.reduceat(fp ^ np.repeat(fp[at], np.diff(np.r_[at, len(fp)])), at)
        self.levels = [(~spread, fp[at] & ~spread)]
        while len(self.levels[-1][0]) > FAN:
            mask, bits = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            spread = np.bitwise_or.reduceat(bits ^ np.repeat(bits[at], np.diff(np.r_[at, len(mask)])), at)
            up = np.bitwise_and.reduceat(mask, at) & ~spread
            self.levels.append((up, bits[at] & up))

    def spanning(self, radius: int, agreed: int = 0, block: int = 1 << 10) -> Forest:
        """Connects members within `radius` bits; those that differ on agreed bits needn't be."""
        n, forest, agreed = len(self.fp), Forest(len(self.fp)), np.uint64(agreed)
        top = len(self.levels) - 1
        work = [(top, *np.triu_indices(len(self.levels[top][0])))]
        width = [LEAF * FAN**k for k in range(top + 1)]
        one = self.uniform(forest, width)
        while work:
            level, i, j = work.pop()
            if len(i) > block:
                work.append((level, i[block:], j[block:]))
                i, j = i[:block], j[:block]
            mask, bits = self.levels[level]
            apart = (bits[i] ^ bits[j]) & mask[i] & mask[j]
            a, b = one[level][i], one[level][j]
            near = (np.bitwise_count(apart) <= radius) & (apart & agreed == 0) & ((a < 0) | (a != b))
            self.dropped += len(i) - int(near.sum())
            i, j = i[near], j[near]
            if not len(i):
                continue
            step, end = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, n)
            k = np.arange(step)
            x = (i[:, None, None] * step + k[:, None] + 0 * k).ravel()
            y = (j[:, None, None] * step + k + 0 * k[:, None]).ravel()
            ok = (x < end) & (y < end) & ((x < y) if not level else (x <= y))
            x, y = x[ok], y[ok]
            if level:
                order = np.argsort(y - x, kind="stable")  # near neighbours first: they connect most
                work.append((level - 1, x[order], y[order]))
                continue
            self.compared += len(x)
            hit = np.bitwise_count(self.fp[x] ^ self.fp[y]) <= radius
            if hit.any():
                forest.join(x[hit], y[hit])
                one = self.uniform(forest, width)
        return forest

    @staticmethod
    def uniform(forest: Forest, width: list[int]) -> list[np.ndarray]:
        """For each node the label that all its members have, or -1."""
        out = []
        for w in width:
            at = np.arange(0, len(forest.label), w)
            low, high = np.minimum.reduceat(forest.label, at), np.maximum.reduceat(forest.label, at)
            out.append(np.where(low == high, low, -1))
        return out


def links_of(radius: int, masks: list[int]):
    """Links (a, b: nodes) that connect what each bucket holds: an index over all buckets of a
    task that agree on the same bits."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in group_runs(batches, ["tree", "masked", "cell_i", "cell_j"], limit=1 << 18):
            fp, tree, node = table.column("fp").to_numpy().view(np.uint64), table.column("tree").to_numpy(), table.column("rep").to_numpy()
            edge = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1], True])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                label = GrayIndex(fp[s:e]).spanning(radius, masks[tree[s]] & (1 << 64) - 1).label
                keep = np.flatnonzero(label != np.arange(e - s))
                yield pa.RecordBatch.from_arrays([pa.array(node[s + keep]), pa.array(node[s + label[keep]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return contract(found(batches))

    return run


def buckets(reps: DataFrame, radius: int, masks: list[int], levels: int, split_over: int) -> DataFrame:
    """tree (which bits agree), masked (their values), fp, rep, cell_i, cell_j: two fingerprints
    within radius meet in a bucket. Buckets of over split_over fingerprints are split on further
    blocks, and only what is as large still after `levels` is compared in cells."""
    n, all_ = radius + 1, F.array(*map(F.lit, masks))

    def below(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("tree", F.explode(F.sequence(F.col("tree") * n + 1, F.col("tree") * n + n)))
        return dealt.withColumn("masked", F.col("fp").bitwiseAND(F.get(all_, F.col("tree"))))

    keys, done = ["tree", "masked"], None
    rows = below(reps.select("fp", "rep", F.lit(0).alias("tree")))
    for level in range(1, levels + 1):
        hot = cut_lineage(rows.groupBy(*keys).count().where(F.col("count") > split_over).select(*keys))
        k = hot.count()
        if not k or level == levels:
            break
        hot = F.broadcast(hot) if k <= 50_000 else hot  # the bound of what is broadcast
        rest = rows.join(hot, keys, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = below(rows.join(hot, keys, "left_semi").select("fp", "rep", "tree"))
    last = in_cells(rows, keys, "fp", split_over).drop("part") if k else rows.withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0)})
    return last if done is None else last.unionByName(done.withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0)}))


def components_of(prints: DataFrame, radius: int = 4, split_over: int = 50_000, levels: int = 3) -> DataFrame:
    """From doc_id, fp: fp and component_id (smallest id reachable) for each distinct fingerprint."""
    reps, top = named_nodes(cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))))
    masks = agreed_masks(radius, levels)
    keys = ["tree", "masked", "cell_i", "cell_j"]
    rows = buckets(reps, radius, masks, levels, split_over)
    dealt = rows.repartition(*keys).sortWithinPartitions("tree", gray_rank(F.col("masked")), "cell_i", "cell_j", gray_rank(F.col("fp")))
    roots = connected_components(map_batches(dealt, links_of(radius, masks), "a long, b long"), contracted=True)
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return named.withColumn("component_id", F.when(F.col("component_id") <= top, F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row."""
    prints = cut_lineage(fingerprints(docs, words, seed))
    found = prints.join(components_of(prints, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
