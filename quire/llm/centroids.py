"""Centroid clustering in exact integers, with float32 screening.

Vectors become integers, floor(scale * x). In each round every vector goes to its nearest centroid
by squared Euclidean distance, the smaller number on ties, and every centroid that has vectors
becomes the componentwise floor of their mean. A vector x differs from centroid c by
|c|^2 - 2 x.c, up to a term that all centroids share, so one float32 matrix product gives all
scores of a block. Each score has an interval that holds the exact value whatever the order of
summation (`radius`). A centroid is out where its lower end lies above the smallest upper end; where
more than one stays in, the exact integer distances of those that do decide.

Sums are exact at any size: a task adds its own vectors and hands on one row for each cluster and
each limb of 32 bits, which Spark adds up. The driver sees clusters x limbs rows a round, whatever
the number of vectors. Rounds end early when no centroid moves, since all later ones would do the
same. The kept vectors are a reliable checkpoint; tasks hold a block at a time.

Defined results: vectors with another number of components, or null or non-finite ones, are left
out, as null vectors are; components of any finite size are exact (beyond `SMALL` by Python's
integers, in their own path); distances and inertias over 2^63 - 1 are given as 2^63 - 1. Rows of
one id are vectors of their own, which all count. For the first centroids equal hashes are ordered
by components; a null id is hashed as the bare seed. Fewer vectors than centroids give as many
centroids as vectors; an empty table gives no row. Only id and vector columns are read, so other
columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches

SMALL = 1 << 26  # up to this size of components a squared distance of 64 or fewer fits 62 bits
LIMB = 32
LARGEST = (1 << 63) - 1
ROUNDING = 2.0**-24  # relative error of one float32 operation


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, for results up to SMALL; scale is a power of two."""
    return np.floor(x * scale).astype(np.int64)


def exact_integers(x: np.ndarray, scale: int) -> list[int]:
    """The same as Python's integers. From 2^53 on a double is an integer itself."""
    return [int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in x.tolist()]


class Centroids:
    """assign(x) gives the nearest centroid of integer rows and the exact squared distances."""

    def __init__(self, rows: list[list[int]], block: int = 1 << 22):
        self.rows, self.k, self.dims = rows, len(rows), len(rows[0]) if rows else 0
        self.small = all(abs(v) <= SMALL for r in rows for v in r) and self.dims <= 64
        self.step = max(block // max(self.k, self.dims, 1), 1)
        self.screened = self.recomputed = 0
        if self.small:
            self.exact = np.array(rows, np.int64).reshape(self.k, self.dims)
            self.squares = (self.exact**2).sum(1)
            self.norms = np.sqrt(self.squares.astype(np.float64))
            self.single = np.ascontiguousarray(self.exact.T.astype(np.float32))

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Bounds |score - exact score|. A float32 dot product of n terms, its operands rounded too,
        errs by at most g * sum |x_i c_i| with g = (n + 2) u / (1 - (n + 2) u), in any order of
        summation; the sum is at most |x| |c|. Norms and the last difference are doubles, for whose
        rounding a part in 2^40 of each term is far more than enough."""
        g = (self.dims + 2) * ROUNDING / (1 - (self.dims + 2) * ROUNDING)
        product = np.outer(norms, self.norms)
        return 2 * g * (1 + 2.0**-40) * product + 2.0**-40 * (self.squares + 2 * product + np.abs(scores))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.empty(len(x), np.int64)
        for i in range(0, len(x), self.step):
            part = x[i : i + self.step]
            scores = self.squares - 2 * (part.astype(np.float32) @ self.single).astype(np.float64)
            r = self.radius(np.sqrt((part.astype(np.float64) ** 2).sum(1)), scores)
            inside = scores - r <= (scores + r).min(1, keepdims=True)
            found = inside.argmax(1)
            close = np.flatnonzero(inside.sum(1) > 1)
            self.screened, self.recomputed = self.screened + len(part), self.recomputed + len(close)
            at, which = np.nonzero(inside[close])
            for j in range(0, len(at), self.step):  # all overlapping candidates, a block of pairs at a time
                a, w = at[j : j + self.step], which[j : j + self.step]
                d = ((part[close[a]] - self.exact[w]) ** 2).sum(1)
                if j == 0:
                    least = np.full(len(close), np.iinfo(np.int64).max)
                better = np.full(len(close), np.iinfo(np.int64).max)
                np.minimum.at(better, a, d)
                hit = (d == better[a]) & (d < least[a])
                least = np.minimum(least, better)
                # of equal ones the smallest number: candidates are ascending, so the first one written last
                found[close[a[hit][::-1]]] = w[hit][::-1]
            best[i : i + self.step] = found
        return best, ((x - self.exact[best]) ** 2).sum(1) if len(x) else np.zeros(0, np.int64)

    def assign_exact(self, row: list[int]) -> tuple[int, int]:
        d, i = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), i) for i, c in enumerate(self.rows))
        return i, d


def blocks(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Rows that are small, their integers, and the integers of the others by row."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    small = (np.abs(x) <= (SMALL - 1) / scale).all(1)
    return np.flatnonzero(small), integers(x[small], scale), {int(i): exact_integers(x[i], scale) for i in np.flatnonzero(~small)}


def nearest(batch: pa.RecordBatch, centroids: Centroids, scale: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Cluster and distance of each row, with the small rows' places and integers and the others."""
    at, x, large = blocks(batch, scale)
    cluster, distance = np.zeros(batch.num_rows, np.int64), [0] * batch.num_rows
    if centroids.small:
        cluster[at], d = centroids.assign(x)
        for i, v in zip(at.tolist(), d.tolist(), strict=True):
            distance[i] = v
    else:
        for i, row in zip(at.tolist(), x.tolist(), strict=True):
            cluster[i], distance[i] = centroids.assign_exact(row)
    for i, row in large.items():
        cluster[i], distance[i] = centroids.assign_exact(row)
    return cluster, distance, at, x, large


def limbs(values: list[int]) -> list[list[int]]:
    """Digits in base 2^LIMB of integers, each with the sign of its integer."""
    out = []
    while any(values):
        out.append([(abs(v) & ((1 << LIMB) - 1)) * (1 if v >= 0 else -1) for v in values])
        values = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in values]
    return out or [[0] * len(values)]


def kept(vectors: DataFrame, dims: int, vector: str, key: str) -> DataFrame:
    v = F.col(vector).cast("array<double>") if vectors.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>") else F.col(vector)
    fine = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    return vectors.select(F.col(key).alias("key"), v.alias("vector")).where(fine)


def first_centroids(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    chosen = rows.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return [exact_integers(np.array(r.vector, np.float64), scale) for r in chosen]


def moved(rows: DataFrame, centroids: Centroids, scale: int) -> list[list[int]]:
    """The centroids after one round."""
    dims = centroids.dims

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * centroids.k, [[0] * dims for _ in range(centroids.k)]
        for batch in batches:
            cluster, _, at, x, large = nearest(batch, centroids, scale)
            part = np.zeros((centroids.k, dims), np.int64)
            np.add.at(part, cluster[at], x)
            for i, row in large.items():
                total[cluster[i]] = [a + b for a, b in zip(total[cluster[i]], row, strict=True)]
            for c, m in enumerate(np.bincount(cluster, minlength=centroids.k).tolist()):
                if m:
                    n[c] += m
                    total[c] = [a + b for a, b in zip(total[c], part[c].tolist(), strict=True)]
        out = [(c, i, n[c] if i == 0 else 0, digits) for c in range(centroids.k) if n[c] for i, digits in enumerate(limbs(total[c]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["cluster", "limb", "n", "digits"])

    partial = map_batches(rows, sums, "cluster long, limb long, n long, digits array<long>")
    added = partial.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("digits")[i]).alias(f"d{i}") for i in range(dims)])
    counts, total = [0] * centroids.k, [[0] * dims for _ in range(centroids.k)]
    for r in added.collect():
        counts[r.cluster] += r.n
        total[r.cluster] = [t + (r[f"d{i}"] << (LIMB * r.limb)) for i, t in enumerate(total[r.cluster])]
    return [[t // counts[c] for t in total[c]] if counts[c] else centroids.rows[c] for c in range(centroids.k)]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """key, cluster and distance of each kept vector, and the final centroids."""
    rows = cut_lineage(kept(vectors, dims, vector, key))
    centroids = Centroids(first_centroids(rows, k, seed, scale))
    for _ in range(rounds if centroids.k else 0):
        after = moved(rows, centroids, scale)
        if after == centroids.rows:
            break
        centroids = Centroids(after)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, *_ = nearest(batch, centroids, scale)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster, pa.int32()), pa.array([min(d, LARGEST) for d in distance], pa.int64())], names=[key, "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return map_batches(rows, assign, f"`{key}` {kind}, cluster int, distance long"), centroids.rows


def clusters(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """What `cluster_vectors` finds, with cluster_inertia, inertia and centroid_sha256 for each row.
    The table that is joined has one row a cluster."""
    found, centroids = cluster_vectors(vectors, key=key, **options)
    found = cut_lineage(found)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LARGEST)
    facts = [(c, min(sums.get(c, 0), LARGEST), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    about = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
