"""Centroid clustering against exact rounds in Python's integers, and its screening by itself."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quire.llm.centroids import LARGEST, Centroids, clusters, exact_integers, limbs
from quire.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, key string, vector string"


def brute(rows, k, rounds, dims):
    kept = [(i, exact_integers(np.array(v, np.float64), 1024)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [r[1] for r in order[:k]]
    far = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(far(x)[1], []).append(x)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *far(x)) for i, x in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, c, min(d, LARGEST), min(inertia[c], LARGEST), min(sum(inertia.values()), LARGEST), sha[c])) for i, d, c in found)


def rows_of(df):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("spread", [0.01, 1.0, 1e4])
def test_whole_results(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(120, 4)) * spread).tolist())]
    rows += [(i, [round(x) / 1024 for x in rng.integers(-2, 3, 4).tolist()]) for i in range(200, 260)]  # ties and repeated vectors
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (5, [0.5] * 4), (300, None), (301, [1.0] * 3), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("-inf"), 0.0, 0.0, 0.0]), (305, [])]
    assert rows_of(clusters(frame(spark, rows), k=5, rounds=4, dims=4)) == brute(rows, 5, 4, 4)


def test_components_of_any_size(spark):
    rows = [(i, [float(i), -1.0 / (i + 1)]) for i in range(12)] + [(20, [1e300, -3.3]), (21, [1.7e308, 1.7e308]), (22, [3e7, 0.1]), (23, [5e-324, -5e-324])]
    assert rows_of(clusters(frame(spark, rows), k=3, rounds=3, dims=2)) == brute(rows, 3, 3, 2)


def test_few_and_no_vectors(spark):
    assert rows_of(clusters(frame(spark, [(1, [1.0]), (2, [2.0])]), dims=1)) == brute([(1, [1.0]), (2, [2.0])], 8, 10, 1)
    assert rows_of(clusters(frame(spark, [(1, None)]), dims=1)) == []
    assert rows_of(clusters(frame(spark, [(1, [7.0])] * 3), dims=1)) == brute([(1, [7.0])] * 3, 8, 10, 1)


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 20, 1 << 26])
def test_intervals_hold_the_exact_scores(size):
    rng = np.random.default_rng(size)
    c, x = rng.integers(-size, size + 1, (16, 64)), rng.integers(-size, size + 1, (500, 64))
    one = Centroids(c.tolist(), block=1000)
    scores = one.squares - 2 * (x.astype(np.float32) @ one.single).astype(np.float64)
    exact = np.array([[int(sum(int(b) * (int(b) - 2 * int(a)) for a, b in zip(row, cent, strict=True))) for cent in c] for row in x[:40]], dtype=object)
    r = one.radius(np.sqrt((x.astype(np.float64) ** 2).sum(1)), scores)
    assert all(abs(int(exact[i, j]) - scores[i, j]) <= r[i, j] for i in range(40) for j in range(16))
    found, d = one.assign(x)
    want = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(row, cent, strict=True)) for cent in c] for row in x[:40]], dtype=object)
    assert found[:40].tolist() == [int(w.argmin()) for w in want] and d[:40].tolist() == [int(w.min()) for w in want]


def test_only_overlapping_intervals_are_recomputed():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (8, 64))
    one = Centroids([*c.tolist(), c[3].tolist()])
    found, _ = one.assign(np.r_[c[:3] + 1, (c[3:4] + c[4:5]) // 2, c[3:4]])
    assert found[:3].tolist() == [0, 1, 2] and found[4] == 3  # of two equal centroids the smaller number
    assert one.screened == 5 and 1 <= one.recomputed <= 2


def test_limbs_add_up():
    for v in ([0, 0], [5, -5], [1 << 200, -(1 << 70) - 3]):
        assert [sum(digits[i] << (32 * n) for n, digits in enumerate(limbs(v))) for i in range(2)] == v


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    cur = con.execute(ORACLE_SQL["op11_centroids"])
    names = [d[0] for d in cur.description]
    want = sorted(repr([dict(zip(names, r, strict=True))[n] for n in sorted(names)]) for r in cur.fetchall())
    got = QUERIES["op11_centroids"](spark, "/root/testdata/sf0.001")
    assert sorted(repr([r[n] for n in sorted(names)]) for r in got.collect()) == want
