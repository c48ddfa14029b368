"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences, and every run of `run` consecutive sentences - more, until it has
`min_words` words - is hashed, once. Over the corpus each span belongs to the first place that has
it (smallest doc_id, then the earliest run). A sentence that lies in a span at any other place is
removed, with the white space up to the next sentence; all else of a text stays as it is, character
by character. A span's key are two hashes of 64 bits by different polynomials.

Runs of fewer than `min_words` words are no spans, so licence lines and stock phrases stay where
they stand alone, and so do the last sentences of a repeated passage if they have fewer words and no
run within the passage ends with them. `passage` (words; 0 by default) leaves shorter stretches of
covered sentences in.

Spans' places are grouped by their keys with map-side aggregation; the join that brings first places
to the others has one row a key on one side, so adaptive execution can split a passage that a third
of all documents share. Texts are read twice (hash and rebuild) and shuffled once.

Defined results: null text counts as empty; texts of fewer sentences than a run stay; a row with a
null id stays whole, and nobody loses text to it; rows of one id are one document: what they have
at the same place stays in each; of equal stretches the first stays; an empty table gives no row.
Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, slices, texts_of

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so they have inverses modulo 2**64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        found = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(2 * n, x, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _powers[base] = (found[0], found[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """A hash of values[start:end] for each range, by prefix sums of a polynomial."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def units(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins, and of each sentence the first word, the two hashes and the number
    of words. Words lie between ASCII white space; a sentence ends after . ! ? or with the line."""
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    start, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    if not len(start):
        return start, start, np.zeros((2, 0), np.uint64), start
    lines = np.cumsum(np.r_[0, data == 10])
    stop = _STOP[data[end - 1]]
    stop[:-1] |= lines[start[1:]] > lines[end[:-1]]
    stop[-1] = True
    last = np.flatnonzero(stop)
    first = np.r_[0, last[:-1] + 1]
    hashes = [range_hashes(range_hashes(data, start, end, base), first, last + 1, base) for base in _BASES]
    return start, first, np.stack(hashes), last + 1 - first


def spans(hashes: np.ndarray, sizes: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end and hashes of the run from each sentence on: `run` of them, and more
    until it has `min_words` words. Runs that the text ends before are none."""
    words = np.r_[0, np.cumsum(sizes)]
    first = np.arange(len(sizes))
    end = np.maximum(np.searchsorted(words, words[:-1] + min_words), first + run)
    first, end = first[end <= len(sizes)], end[end <= len(sizes)]
    return first, end, np.stack([range_hashes(h, first, end, base).view(np.int64) for h, base in zip(hashes, _BASES, strict=True)])


def repeated(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """doc_id, place (first sentence << 32 | end): the spans that an earlier place has."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spans(*units(t.encode())[2:], run, min_words) for t in texts_of(batch)]
            again = []
            for _, _, (h, _) in found:
                a = np.ones(len(h), bool)
                a[np.unique(h, return_index=True)[1]] = False
                again.append(a)
            first, end = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            span, check = np.concatenate([f[2] for f in found], axis=1)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            place = first << 32 | end | np.concatenate(again).astype(np.int64) << 63
            yield pa.RecordBatch.from_arrays([pa.array(span), pa.array(check), ids, pa.array(place)], names=["span", "check", "doc_id", "place"])

    # the place of a span that the text has before is negative
    rows = cut_lineage(map_batches(docs.where("doc_id is not null").select("doc_id", "text"), hashed, "span long, check long, doc_id long, place long"))
    key = ["span", "check"]
    owners = rows.groupBy(*key).agg(F.min_by("place", F.when(F.col("place") >= 0, F.col("doc_id"))).alias("owner_place"), F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    # written, so that the join deals out both sides and a span of many rows can be split
    owners = cut_lineage(owners.where("n > 1").drop("n"))
    return rows.join(owners, key).where("doc_id != owner or place != owner_place").select("doc_id", F.col("place").bitwiseAND(F.lit((1 << 63) - 1)).alias("place"))


def without_covered(text: str, places: list[int], passage: int) -> tuple[str, int, int, int]:
    """The text without the sentences that the places cover, in stretches of at least `passage`
    words; the number of sentences, of removed sentences, and of removed words."""
    raw = text.encode()
    start, first, _, sizes = units(raw)
    n = len(first)
    edge = np.zeros(n + 1, np.int64)
    at = np.array(places, np.int64)
    lo, hi = at >> 32, at & ((1 << 32) - 1)
    inside = hi <= n  # else a row of the same id with another text
    np.add.at(edge, lo[inside], 1)
    np.add.at(edge, hi[inside], -1)
    covered = np.diff(np.r_[False, np.cumsum(edge)[:-1] > 0, False].astype(np.int8))
    begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    words = np.r_[0, np.cumsum(sizes)]
    long = words[end] - words[begin] >= passage
    begin, end = begin[long], end[long]
    if not len(begin):
        return text, n, 0, 0
    byte = np.r_[start[first], len(raw)]
    cuts = [0, *np.c_[byte[begin], byte[end]].ravel().tolist(), len(raw)]
    left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return left.decode(), n, int((end - begin).sum()), int((words[end] - words[begin]).sum())


def dedup(docs: DataFrame, run: int = 2, min_words: int = 15, passage: int = 0, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text (what is left of it), n_units (sentences), n_removed, removed_words of each
    document, and the columns named in carry."""
    carry = carry or []

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places = batch.column("places")
            rows = [without_covered(t, places[i].as_py() or [], passage) for i, t in enumerate(texts_of(batch))]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *(batch.column(c) for c in carry)], names=["doc_id", "text", "n_units", "n_removed", "removed_words", *carry])

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    by_doc = repeated(cols, run, min_words).groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    return map_batches(cols.join(by_doc, "doc_id", "left"), rebuild, f"doc_id long, text string, n_units long, n_removed long, removed_words long{more}")
