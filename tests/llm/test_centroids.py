import hashlib
import random

import duckdb
import numpy as np
import pytest

from tecflow.llm import centroids as ce


def plain(rows, k=8, rounds=10, size=64):
    """rows: (id, list or None). Plain k-means on Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for i, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(pick(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    best = [pick(v) for _, v in kept]
    of = {j: sum(d for d, b in best if b == j) for j in range(len(cents))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, of[j], sum(of.values()), shas[j]) for (i, _), (d, j) in zip(kept, best, strict=True)), key=str)


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def clouds(n, rng, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.7])
def test_equals_plain_loops(spark, spread):
    rows = clouds(1300, random.Random(1), spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert rows_of(ce.clustered(df)) == plain(rows)


def test_odd_rows_ties_and_hot_vectors(spark):
    rng = random.Random(2)
    rows = clouds(60, rng, 0.3)
    rows += [(100 + i, rows[0][1]) for i in range(400)] + [rows[3], rows[3], (None, rows[5][1])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 63), (7003, [0.0] * 65), (7004, [None] + [0.0] * 63), (7005, [float("nan")] * 64), (7006, [float("-inf")] + [0.0] * 63), (7007, [-1e-30] * 64), (7008, [9000.0] * 64)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, x int").repartition(4)
    assert rows_of(ce.clustered(df)) == plain(rows)


def test_centroids_that_are_equal_and_few_vectors(spark):
    for rows in ([(i, [0.5] * 64) for i in range(40)], [(1, [0.25] * 64)], [(i, [float(i)] * 64) for i in range(5)], []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert rows_of(ce.clustered(df)) == plain(rows)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        ce.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_every_row_of_a_tree_once_and_to_its_nearest_centroid():
    rng = np.random.default_rng(3)
    whole = 0
    for n in (1, 2, 15, 16, 17, 100, 256):
        for scale in (3, 1000, 1 << 26):
            cents = rng.integers(-scale, scale, (8, 6))
            cents[3] = cents[5]
            rows = cents[rng.integers(0, 8, n)] + rng.integers(-max(1, scale // 20), max(1, scale // 20) + 1, (n, 6))
            order, tree = ce.Balls.packed(rows)
            assert (tree.rows == rows[order]).all() and sorted(order) == list(range(n))
            got = np.full(n, -1)
            for node, a, b, c in tree.assigned(cents):
                assert (got[a:b] == -1).all()
                got[a:b] = c
                if node >= 0:
                    whole += b - a > 1
                    assert tree.count[node] == b - a and (tree.total[node] == tree.rows[a:b].sum(axis=0)).all()
            assert got.tolist() == [min(range(8), key=lambda j: (sum((int(x) - int(y)) ** 2 for x, y in zip(r, cents[j], strict=True)), j)) for r in tree.rows]
    assert whole  # balls do go as a whole


def test_query_equals_sql(spark):
    want = duckdb.sql(ce.SQL.replace("from embeddings", "from '/root/testdata/sf0.001/embeddings.parquet'")).fetchall()
    got = rows_of(ce.clustered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")))
    assert got == sorted(want, key=str)
