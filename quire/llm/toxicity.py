"""Toxicity scores from bags of subwords.

Words fall into byte n-grams (with marks at their ends), each n-gram has an embedding, and a
window of a few words is the average of its n-grams' embeddings, which a linear softmax scores.
A document's score is that of its most toxic window, so one insult counts as much in a long text
as in a short one. Embeddings and softmax are trained jointly in numpy, on windows of a bounded
sample of labelled documents: at first the windows whose n-grams tell most about the labels, then
those that the model so far finds most toxic, in toxic and in clean documents. Unseen spellings
share n-grams with seen ones.

Labels are learnt only from rows where crc32(doc_id as text) mod 3 is not 1, and the sample is
bounded by `max_rows` documents of each label (the first by hash of the id); texts are read whole.
The score of text needs nothing but the text.

Defined results: null and empty texts, and all texts if there is nothing to learn from, get the
score of an empty bag; labels without a document or with null toxic are left out, and of several
for one id the highest counts; repeated rows get equal scores; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, slices, texts_of

BITS = 18
SIZES = (3, 4, 5, 6)
WINDOW = 3  # words

_WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    """table: for each n-gram bucket its embedding times the softmax's weight difference."""

    table: np.ndarray
    bias: float


@dataclass
class Grams:
    """Of a batch of texts: the first place, length and first window of each text, and for each
    place of the flat bytes its window; buckets(n) gives the n-gram buckets and which exist."""

    flat: np.ndarray
    window: np.ndarray
    first_window: np.ndarray

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b = self.flat.astype(np.uint32)
        space = self.flat == 32
        n = len(b)
        h = np.zeros(n, np.uint32)
        inner = np.ones(n, bool)  # no mark between the first and the last byte
        power = np.uint32(1)
        for size in range(1, SIZES[-1] + 1):
            m = n - size + 1
            if m <= 0:
                return
            h = h[:m] + b[size - 1 :] * power
            power = np.uint32(int(power) * 0x01000193 & 0xFFFFFFFF)
            if size > 2:
                inner = inner[:m] & ~space[size - 2 : n - 1]
            if size in SIZES:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * size)
                yield x >> np.uint32(32 - BITS), inner


def grams(texts: list[str]) -> Grams:
    rows = [b" " + b" ".join(t.lower().encode().translate(_WORD_BYTES).split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(rows), np.uint8)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.cumsum(sizes) - sizes
    seen = np.cumsum(flat == 32) - 1  # marks before each place, over all texts
    word = seen - np.repeat(seen[start], sizes)
    words = np.maximum(np.fromiter((r.count(b" ") - 1 for r in rows), np.int64, len(rows)), 1)
    windows = -(-words // WINDOW)
    first = np.cumsum(windows) - windows
    window = np.repeat(first, sizes) + np.minimum(word, np.repeat(words, sizes) - 1) // WINDOW
    return Grams(flat, window, np.r_[first, windows.sum()])


def window_logits(g: Grams, model: Model) -> np.ndarray:
    total, count = np.zeros(len(g.flat), np.float32), np.zeros(len(g.flat), np.float32)
    for bucket, ok in g.buckets():
        total[: len(ok)] += np.where(ok, model.table[bucket], np.float32(0))
        count[: len(ok)] += ok
    n = g.first_window[-1]
    return np.bincount(g.window, total, n) / np.maximum(np.bincount(g.window, count, n), 1) + model.bias


def text_scores(texts: list[str], model: Model) -> np.ndarray:
    """The softmax probability of the most toxic window of each text."""
    g = grams(texts)
    return 1 / (1 + np.exp(-np.maximum.reduceat(window_logits(g, model), g.first_window[:-1])))


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task: in how many documents of each label each bucket occurs."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in slices(batches, limit=1 << 18):
        for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            seen = np.zeros(1 << BITS, bool)
            for bucket, ok in grams([text]).buckets():
                seen[bucket[ok]] = True
            counts[label] += seen
    yield pa.RecordBatch.from_pydict({"counts": [counts.tobytes()]})


def best_windows(batches: Iterator[pa.RecordBatch], model: Model, top: int, spread: int, sure: float = 3.0) -> Iterator[pa.RecordBatch]:
    """The buckets of each document's highest windows - of a toxic one's the first, and more only
    where the model is sure - and of `spread` others if it is clean."""
    for batch in slices(batches, limit=1 << 18):
        out: tuple[list, list] = ([], [])
        for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            g = grams([text])
            score = window_logits(g, model)
            chosen = np.argsort(-score, kind="stable")[:top]
            if label:
                chosen = chosen[(score[chosen] > sure) | (np.arange(len(chosen)) == 0)]
            else:
                chosen = np.union1d(chosen, np.linspace(0, len(score) - 1, spread).astype(int))
            parts = [(b[ok], g.window[: len(ok)][ok]) for b, ok in g.buckets()]
            b, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, int))
            for c in chosen.tolist():
                out[0].append(label)
                out[1].append(b[w == c].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["toxic", "bag"])


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, width: int = 8, rate: float = 0.5, batch: int = 128, seed: int = 5) -> Model:
    """Embeddings (buckets x width) and softmax (width x 2) by Adagrad on mini-batches in which
    both labels weigh the same."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (1 << BITS, width)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(1 << BITS, 1e-4, np.float32), np.full((width, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
    share = np.array([(labels == y).mean() for y in (0, 1)])
    weight = (0.5 / np.maximum(share, 1e-9)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            size = np.array([len(bags[r]) for r in rows])
            flat = np.concatenate([bags[r] for r in rows])
            ids, at = np.unique(flat, return_inverse=True)
            row = np.repeat(np.arange(len(rows)), size)
            e = emb[ids]
            mean = np.stack([np.bincount(row, e[at, k], len(rows)) for k in range(width)], 1) / np.maximum(size, 1)[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            d = p * weight[labels[rows]][:, None] / len(rows)
            d_mean = (d @ soft.T) / np.maximum(size, 1)[:, None] * len(rows)
            d_emb = np.stack([np.bincount(at, d_mean[row, k], len(ids)) for k in range(width)], 1)
            d_soft, d_bias = mean.T @ d + 1e-4 * soft, d.sum(0)
            g_emb[ids] += (d_emb**2).mean(1)
            g_soft += d_soft**2
            g_bias += d_bias**2
            emb[ids] -= (rate * d_emb / np.sqrt(g_emb[ids])[:, None]).astype(np.float32)
            soft -= (0.1 * d_soft / np.sqrt(g_soft)).astype(np.float32)
            bias -= (0.1 * d_bias / np.sqrt(g_bias)).astype(np.float32)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic of at most max_rows documents of each label that may be learnt from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * max_rows ids, which is what bounds this broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, rounds: int = 2) -> Model:
    rows = cut_lineage(training_rows(docs, labels, max_rows))
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -6.0 if 1 not in seen else 6.0)
    few = rows.coalesce(8)  # a bounded sample
    counts = np.zeros((2, 1 << BITS), np.int64)
    for r in map_batches(few, document_counts, "counts binary").toLocalIterator():
        counts += np.frombuffer(r["counts"], np.int32).reshape(2, -1)
    odds = np.log((counts[1] + 0.5) / (seen[1] + 1)) - np.log((counts[0] + 0.5) / (seen[0] + 1))
    model = Model(np.maximum(odds, 0).astype(np.float32), 0.0)
    bags: dict[bytes, int] = {}
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))

        def run(batches, shared=shared):
            return best_windows(batches, pickle.loads(shared.value), top=4, spread=3)

        found = map_batches(rows, run, "toxic int, bag binary").collect()  # at most 7 windows a row
        bags = {b: y for b, y in bags.items() if not y} | {bytes(r["bag"]): r["toxic"] for r in sorted(found, key=lambda r: (r["toxic"], bytes(r["bag"])))}
        model = train([np.frombuffer(b, np.int32) for b in bags], np.array(list(bags.values())))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted of each row, and the columns named in carry."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in slices(batches, limit=1 << 18):
            s = text_scores(texts_of(batch), own)
            cols = [batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(batch.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", *carry])

    kind = {c: docs.schema[c].dataType.simpleString() for c in ["doc_id", *carry]}
    more = "".join(f", `{c}` {kind[c]}" for c in carry)
    cols = ["doc_id", *dict.fromkeys([*carry, "text"])]
    return map_batches(docs.select(cols), run, f"doc_id {kind['doc_id']}, score double, predicted int{more}")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 2500) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    found = score(docs, fit(docs, labels, max_rows), threshold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
