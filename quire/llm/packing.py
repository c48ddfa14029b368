"""Best-fit packing of documents into sequences of a fixed capacity.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus holds) reaches
the driver. There a configuration linear program - how often to use each way to fill a sequence -
is solved by multiplicative weights: each length class has a weight that falls as the class gets
covered, and a knapsack dynamic program finds the most valuable configuration at these weights.
The solution is rounded down to whole sequences; what is left, and the short pieces held back as
filler, goes best-fit into the gaps, and into new sequences at last. Everything is done in bulk on
counts, so the plan is a bounded list of runs: "pieces of length l with ranks from a to b go, k to
a sequence, to the sequences from s on, at offset o". Ranks are dealt on the cluster.

Defined results: null or empty text is a piece of its end id only; documents longer than the
capacity are cut, all others stay whole; repeated rows are packed as rows of their own; an empty
table gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, slices, texts_of
from quire.llm.bpe import BATCH, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, engine: str = "library", cache_words: int = 400_000) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, step = encoder(path, engine, cache_words), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in slices(batches, limit=BATCH):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch)), strict=True):
                ids += tail
                rows += [(doc, k, i // 4, len(part := ids[i : i + step]) // 4, zlib.crc32(part)) for k, i in enumerate(range(0, len(ids), step))]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


@dataclass
class Fill:
    """`times` sequences filled alike: (length, pieces in each sequence, first rank)."""

    times: int
    room: int
    items: list[tuple[int, int, int]] = field(default_factory=list)


def price(value: np.ndarray, size: np.ndarray, units: int) -> list[int]:
    """The classes of a most valuable configuration: an unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(units + 1), np.full(units + 1, -1)
    order = np.argsort(size, kind="stable")
    size, value = size[order], value[order]
    upto = np.searchsorted(size, np.arange(units + 1), side="right")
    for c in range(1, units + 1):
        if n := upto[c]:
            x = value[:n] + best[c - size[:n]]
            k = int(x.argmax())
            if x[k] > best[c - 1]:
                best[c], pick[c] = x[k], k
                continue
        best[c] = best[c - 1]
    out, c = [], units
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(order[pick[c]]))
            c -= int(size[pick[c]])
    return out


def configurations(size: np.ndarray, need: np.ndarray, units: int, step: float, rounds: int) -> dict[tuple[tuple[int, int], ...], float]:
    """Multiplicative weights for min sum(x) with every class covered: configuration -> x."""
    x: dict[tuple[tuple[int, int], ...], float] = {}
    cover = np.zeros(len(need))
    for _ in range(rounds):
        open_ = cover < 1
        if not open_.any():
            break
        weight = np.where(open_, np.exp(-2 * cover) * size, 0.0)  # worth its room, less as it is covered
        got = price(weight, size, units)
        kinds, times = np.unique(got, return_counts=True)
        room = (step * need[kinds] / times).min()
        left = ((1 - cover[kinds]) * need[kinds] / times).min()
        use = max(min(room, left), 1e-9)
        key = tuple(zip(kinds.tolist(), times.tolist(), strict=True))
        x[key] = x.get(key, 0.0) + use
        cover[kinds] += use * times / need[kinds]
        cover[cover > 1 - 1e-9] = 1
    return x


def plan(histogram: dict[int, int], capacity: int, classes: int = 96, units: int = 512, step: float = 0.2, rounds: int = 1500, filler: float = 0.2) -> list[Fill]:
    """Fills that use each piece of the histogram once."""
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    fills: list[Fill] = []

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        return first

    if n := left.get(capacity, 0):
        fills.append(Fill(n, 0, [(capacity, 1, take(capacity, n))]))
    lengths = sorted(k for k, n in left.items() if n)
    total, held, start = sum(k * left[k] for k in lengths), 0, 0
    while start < len(lengths) and held + lengths[start] * left[lengths[start]] <= filler * total:
        held += lengths[start] * left[lengths[start]]
        start += 1
    big = lengths[start:]
    if big:
        mass = np.cumsum([k * left[k] for k in big], dtype=float)
        group = np.minimum((mass - mass[0]) / max(mass[-1], 1) * classes, classes - 1).astype(int)
        members = [[k for k, g in zip(big, group, strict=True) if g == c] for c in np.unique(group)]
        unit = capacity / units
        size = np.array([int(np.ceil(m[-1] / unit)) for m in members])
        need = np.array([sum(left[k] for k in m) for m in members], dtype=float)
        solved = configurations(size, need, units, step, rounds)
        for config, x in sorted(solved.items(), key=lambda kv: -kv[1]):
            times = int(x)
            while times > 0:  # in each turn, as many sequences as the longest pieces of the classes allow
                chosen: dict[int, int] = {}
                for c, k in config:
                    for length in reversed(members[c]):
                        while k and left[length] - chosen.get(length, 0) > 0:
                            chosen[length] = chosen.get(length, 0) + 1
                            k -= 1
                room = capacity - sum(k * n for k, n in chosen.items())
                if not chosen or room < 0:
                    break
                # classes are rounded up: for the shortest piece, the longest that fits goes in
                least = min(chosen)
                for length in range(room + least, least, -1):
                    if left.get(length, 0) > chosen.get(length, 0):
                        chosen[least] -= 1
                        chosen = {k: n for k, n in chosen.items() if n}
                        chosen[length] = chosen.get(length, 0) + 1
                        room -= length - least
                        break
                now = min(times, *(left[k] // n for k, n in chosen.items()))
                fills.append(Fill(now, room, [(k, n, take(k, now * n)) for k, n in chosen.items()]))
                times -= now
    best_fit(fills, left, take, capacity)
    return fills


def best_fit(fills: list[Fill], left: dict[int, int], take, capacity: int) -> None:
    """Puts what is left, longest first, each into the tightest gap; new sequences where none is."""
    gaps: list[list[Fill]] = [[] for _ in range(capacity + 1)]
    for f in fills:
        gaps[f.room].append(f)
    top = np.array([len(g) for g in gaps])
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        while left[length]:
            at = np.flatnonzero(top[length:])
            if not len(at):
                each = min(capacity // length, left[length])
                times = left[length] // each
                f = Fill(times, capacity - each * length, [(length, each, take(length, times * each))])
                fills.append(f)
            else:
                room = length + int(at[0])
                f = gaps[room].pop()
                top[room] -= 1
                each = min(room // length, left[length])
                times = min(f.times, left[length] // each)
                if times < f.times:  # the rest of these sequences stays as it is
                    rest = Fill(f.times - times, f.room, [(k, n, r + times * n) for k, n, r in f.items])
                    fills.append(rest)
                    gaps[room].append(rest)
                    top[room] += 1
                f.times, f.room = times, room - each * length
                f.items.append((length, each, take(length, times * each)))
            gaps[f.room].append(f)
            top[f.room] += 1


def runs_of(fills: list[Fill]) -> np.ndarray:
    """length, first rank, end rank, first sequence, pieces in a sequence, offset; by length and rank."""
    out, base = [], 0
    for f in fills:
        offset = 0
        for length, each, rank in f.items:
            out.append((length, rank, rank + f.times * each, base, each, offset))
            offset += length * each
        base += f.times
    table = np.array(out, dtype=np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... among pieces of a length. A length may be a third of all pieces, so
    ranks are dealt within salted parts of it and shifted by the sizes of the parts before."""
    parts = 4 * max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "salt")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, engine: str = "library", cache_words: int = 400_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece. cache_words bounds
    the encoder's memory, which a worker keeps for later tasks, not results."""
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, path, end_id, capacity, engine, cache_words))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(runs_of(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        scale = 1 << 44  # ranks are below
        keys = runs[:, 0] * scale + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * scale + rank, side="right") - 1
            _, first, _, base, each, offset = runs[at].T
            sequence, slot = np.divmod(rank - first, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base + sequence), pa.array(offset + slot * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    cols = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return map_batches(cols, place, f"{PIECES}, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, engine: str = "library") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int), doc_ids, offsets. At most
    `capacity` pieces meet in one row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, step = encoder(path, engine), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in slices(batches, limit=BATCH):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch)), strict=True):
                ids += tail
                rows += [(doc, k, zlib.crc32(ids[i : i + step]), np.frombuffer(ids[i : i + step], "<u4").astype(np.int32)) for k, i in enumerate(range(0, len(ids), step))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["doc_id", "piece", "ids_crc32", "ids"])

    ids = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, "doc_id long, piece int, ids_crc32 long, ids array<int>")
    places = pack(docs, path, end_id, capacity, engine)
    same = Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy(F.lit(0))  # repeated rows pair up one by one
    ids, places = (x.withColumn("n", F.row_number().over(same)) for x in (ids, places))
    keys = ["doc_id", "piece", "ids_crc32", "n"]
    both = places.join(ids.withColumnsRenamed({k: f"{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    rows = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
