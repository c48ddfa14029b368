"""Near-duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations.

Equal vectors (by a hash of 128 bits) are one class from the start, with their count. Each class
is hashed in several tables: a vector is rotated at random (sign flips and Hadamard transforms,
three times), and its hash is the axis it lies closest to; a table joins three such hashes. Besides
its own bucket a vector probes those it was closest to falling into. Ids meet in buckets first, and
vectors are sent only to buckets where they meet another. There all pairs are verified in double
precision. A pair that meets in several buckets counts in the first of them only, which both
vectors' codes tell, so buckets give counts and the links of a spanning forest, never pairs. A
bucket of a great part of all rows is split into cells. A class goes by its smallest id, which is
then the name of its component, so nothing is grouped by component.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing (n_links 0, component_id their own id); vectors of unlike lengths don't link; equal
vectors link with each other; a null id keeps its row and is never a component's name unless
all its ids are null; an empty table gives no row. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches
from quire.llm.components import Forest, connected_components, group_runs, named_nodes


def rotated(x: np.ndarray, rotations: int, seed: int) -> np.ndarray:
    """(rows, rotations, width) with width a power of two: three rounds of signs and Hadamard."""
    n, d = x.shape
    width = 1 << max(d - 1, 0).bit_length()
    signs = np.random.default_rng([seed, width]).choice(np.array([-1.0, 1.0], np.float32), (3, rotations, width))
    y = np.zeros((n, rotations, width), np.float32)
    y[:, :, :d] = x[:, None, :]
    for s in signs:
        y = y * s
        h = 1
        while h < width:
            z = y.reshape(n, rotations, width // (2 * h), 2, h)
            y = np.stack([z[:, :, :, 0] + z[:, :, :, 1], z[:, :, :, 0] - z[:, :, :, 1]], axis=3).reshape(n, rotations, width)
            h *= 2
        y /= np.sqrt(np.float32(width))
    return y


def codes(x: np.ndarray, tables: int, axes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes): a table's own bucket first, then the likeliest others. Where a
    code could pass 31 bits its remainder stands for it, which may join buckets but parts none."""
    y = rotated(x, axes * tables, seed)
    n, _, width = y.shape
    take = min(4, 2 * width)
    both = np.concatenate([y, -y], axis=2)
    axis = np.argpartition(-both, take - 1, axis=2)[:, :, :take]
    value = np.take_along_axis(both, axis, 2)
    order = np.argsort(-value, axis=2, kind="stable")
    axis, value = np.take_along_axis(axis, order, 2), np.take_along_axis(value, order, 2)
    axis, loss = axis.reshape(n, tables, axes, take).astype(np.int64), ((value[:, :, :1] - value) ** 2).reshape(n, tables, axes, take)
    total, code = loss[:, :, 0], axis[:, :, 0]
    for k in range(1, axes):
        total = (total[..., :, None] + loss[:, :, k, None, :]).reshape(n, tables, -1)
        code = (code[..., :, None] * 2 * width + axis[:, :, k, None, :]).reshape(n, tables, -1)
    best = np.argsort(total, axis=2, kind="stable")[:, :, : 1 + probes]
    return (np.take_along_axis(code, best, 2) % 0x7FFFFFFF).astype(np.int32)


def unit(flat: np.ndarray, d: int) -> np.ndarray:
    """Rows of d components in double precision, of length one."""
    x = flat.astype(np.float64).reshape(-1, d)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(batches: Iterator[pa.RecordBatch], tables: int, axes: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """rep, n, h1, h2, d, vector (the components' bytes) and codes of each class."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            lists = batch.column("embedding")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                c = codes(unit(x, d).astype(np.float32), tables, axes, probes, seed)
                some = batch.take(pa.array(at))
                cols = [*(some.column(k) for k in ("rep", "n", "h1", "h2")), pa.array(np.full(len(at), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(c.reshape(len(at), -1)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "n", "h1", "h2", "d", "vector", "codes"])


def first_met(cx: np.ndarray, cy: np.ndarray, x_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table and code where each pair of code lists (pairs, tables, 1 + probes) meets first:
    in the bucket of both; else in y's where the one with the smaller id probes; else the other."""
    own = cx[:, :, 0] == cy[:, :, 0]
    x_in_y = (cx[:, :, 1:] == cy[:, :, :1]).any(axis=2)
    y_in_x = (cy[:, :, 1:] == cx[:, :, :1]).any(axis=2)
    table = (own | x_in_y | y_in_x).argmax(axis=1)
    r = np.arange(len(cx))
    own, x_in_y, y_in_x, hx, hy = own[r, table], x_in_y[r, table], y_in_x[r, table], cx[r, table, 0], cy[r, table, 0]
    first_probes = np.where(x_first, x_in_y, y_in_x)
    at_y = np.where(first_probes, x_first, ~x_first)
    return table, np.where(own | ~at_y, hx, hy)


def verified(tables: int, probes: int, least: float, kind: type, block: int = 1024):
    """From buckets: rows a, b, w - with b null w more links of class a, else a link a-b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in group_runs(batches, ["d", "bucket", "code", "cell_i", "cell_j"], limit=1 << 17):
            cid, n, probe, bucket, code, part = (table.column(c).to_numpy() for c in ("rep", "n", "probe", "bucket", "code", "part"))
            cut = table.column("cell_i").to_numpy() != table.column("cell_j").to_numpy()
            ends = np.r_[first[1:], len(cid)]
            counts: list = []
            links: list = []
            for s, e in zip(first.tolist(), ends.tolist(), strict=True):
                if e - s < 2 or not (probe[s:e] == 0).any():
                    continue
                m = e - s
                v = unit(np.frombuffer(b"".join(table.column("vector").slice(s, m).to_pylist()), kind), table.column("d")[s].as_py())
                c = table.column("codes").slice(s, m).combine_chunks().flatten().to_numpy().reshape(m, tables, 1 + probes)
                base = np.flatnonzero(probe[s:e] == 0)
                gain, forest = np.zeros(m, np.int64), Forest(m)
                for i in range(0, m, block):
                    x, k = np.nonzero(v[i : i + block] @ v[base].T >= least)
                    x, y = x + i, base[k]
                    ok = (cid[s + x] != cid[s + y]) & ((probe[s + x] > 0) | (x < y))
                    if cut[s]:
                        ok &= part[s + x] != part[s + y]
                    x, y = x[ok], y[ok]
                    if not len(x):
                        continue
                    t, h = first_met(c[x], c[y], cid[s + x] < cid[s + y])
                    mine = (t == bucket[s]) & (h == code[s])
                    np.add.at(gain, x[mine], n[s + y[mine]])
                    np.add.at(gain, y[mine], n[s + x[mine]])
                    forest.join(x, y)
                got = np.flatnonzero(gain)
                counts.append((cid[s + got], gain[got]))
                far = np.flatnonzero(forest.label != np.arange(m))
                links.append((cid[s + far], cid[s + forest.label[far]]))
            a, w = (np.concatenate(x) if counts else np.zeros(0, np.int64) for x in (zip(*counts, strict=True) if counts else ((), ())))
            p, q = (np.concatenate(x) if links else np.zeros(0, np.int64) for x in (zip(*links, strict=True) if links else ((), ())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a, p]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(q)]), pa.concat_arrays([pa.array(w), pa.nulls(len(p), pa.int64())])],
                names=["a", "b", "w"],
            )

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, tables: int = 12, axes: int = 3, probes: int = 2, seed: int = 7, split_over: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. tables, axes and probes set the recall."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    real = "float" if single else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{real}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast(real))  # one zero only
    keyed = rows.where(ok).withColumn("embedding", plain).withColumns({f"h{k}": F.xxhash64(F.lit(k), "embedding") for k in (1, 2)})
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes, top = named_nodes(cut_lineage(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return hashed(batches, tables, axes, probes, seed)

    classes = cut_lineage(map_batches(classes.select("rep", "n", "h1", "h2", "embedding"), run, "rep long, n long, h1 long, h2 long, d int, vector binary, codes array<int>"))
    keys = ["d", "bucket", "code"]
    met = classes.select("rep", "d", F.posexplode("codes").alias("at", "code"))
    met = met.select("rep", "d", F.expr(f"at div {1 + probes}").cast("int").alias("bucket"), (F.col("at") % (1 + probes)).alias("probe"), "code")
    # buckets of one class, or of probes only, are left before any vector is sent
    busy = met.groupBy(*keys).agg(F.count("*").alias("size"), F.min("probe").alias("least")).where("size > 1 and least = 0").drop("least")
    parts = F.greatest(F.ceil(F.col("size") / split_over), F.lit(1)).cast("int")
    cells = met.join(busy, keys).join(classes.select("rep", "n", "vector", "codes"), "rep")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.withColumn("cell_i", F.least("part", "other")).withColumn("cell_j", F.greatest("part", "other")).drop("size", "other")
    keys += ["cell_i", "cell_j"]
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    found = cut_lineage(map_batches(dealt, verified(tables, probes, least, np.float32 if single else np.float64), "a long, b long, w long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("w").alias("more")).withColumnRenamed("a", "rep")
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("rep", "n", "h1", "h2").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = named.select("h1", "h2", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.when(F.col("root") <= top, F.col("root")).alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
