"""Exact k-means on whole numbers, filtered by ball trees.

Vectors are packed once, in each partition, into small metric trees: every ball
knows its radius, how many vectors it holds and their sum. In a round a ball goes
to a centroid as a whole when the triangle inequality leaves no other; otherwise
its halves are looked at, with the centroids that are left, and at last its
vectors one by one. A round moves one sum for each centroid and partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import drop_staged, lean, staged

SIZE, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
#: Vectors of a tree and, at most, of a leaf.
TREE, LEAF = 256, 16
#: Components must be smaller than this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Below this, products of components are summed exactly by floating point.
PLAIN = 1 << 22


def components(vec: Column, size: int, scale: int) -> Column:
    """Whole-number components; null unless there are exactly size components, none of them null or not finite."""
    value = lambda x: x.cast("double")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    whole = lambda x: F.floor(value(x) * scale)
    fits = lambda x: F.when(F.abs(whole(x)) < LARGEST, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return F.when((F.size(vec) == size) & fine, F.transform(vec, fits))


@dataclass
class Balls:
    """A tree over vectors in its order. Node j of level l holds rows n * j // 2**l to n * (j + 1) // 2**l; levels follow each other."""

    rows: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    total: np.ndarray

    @staticmethod
    def borders(n: int, level: int) -> np.ndarray:
        return n * np.arange((1 << level) + 1) // (1 << level)

    @staticmethod
    def depth(n: int) -> int:
        return max(0, (-(-n // LEAF) - 1).bit_length())

    @classmethod
    def packed(cls, rows: np.ndarray) -> tuple[np.ndarray, Balls]:
        """(order, tree): every ball is halved along its widest component."""
        n, order = len(rows), np.arange(len(rows))
        depth = cls.depth(n)
        for level in range(depth):
            outer, inner = cls.borders(n, level), cls.borders(n, level + 1)
            for j in range(1 << level):
                part = order[outer[j] : outer[j + 1]]
                there = rows[part]
                widest = int(np.argmax(there.max(axis=0) - there.min(axis=0)))
                order[outer[j] : outer[j + 1]] = part[np.argpartition(there[:, widest], inner[2 * j + 1] - outer[j], kind="introselect")]
        rows = rows[order]
        radius, count, total = [], [], []
        for level in range(depth + 1):
            at = cls.borders(n, level)
            held, sums = np.diff(at), np.add.reduceat(rows, at[:-1], axis=0)
            off = np.sqrt(((rows - np.repeat(sums / held[:, None], held, axis=0)) ** 2).sum(axis=1))
            radius.append(np.maximum.reduceat(off, at[:-1]))
            count.append(held)
            total.append(sums)
        return order, cls(rows, np.concatenate(radius), np.concatenate(count), np.concatenate(total))

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(node, first row, end, cluster) of whole balls and (-1, row, row + 1, cluster) of single vectors; together every row once."""
        n, depth, far = len(self.rows), self.depth(len(self.rows)), float("inf")
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        for level in range(depth + 1):
            at, here = self.borders(n, level), (1 << level) - 1 + nodes
            middle = self.total[here] / self.count[here][:, None]
            d = np.sqrt(((middle[:, None, :] - centroids) ** 2).sum(axis=2))
            d[~left] = far
            best = d.argmin(axis=1)
            near, radius = d[np.arange(len(d)), best], self.radius[here]
            # What rounding may do to lengths of this size; a doubtful centroid stays.
            slack = 1e-9 * (1 + near + radius + np.abs(middle).max(axis=1))
            left = d - radius[:, None] <= (near + radius + slack)[:, None]
            whole = left.sum(axis=1) == 1
            for k in np.flatnonzero(whole):
                yield int(here[k]), int(at[nodes[k]]), int(at[nodes[k] + 1]), int(best[k])
            nodes, left = nodes[~whole], left[~whole]
            if not len(nodes):
                return
            if level < depth:
                nodes, left = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(left, 2, axis=0)
        at = self.borders(n, depth)
        rows = np.concatenate([np.arange(at[j], at[j + 1]) for j in nodes])
        d = squared(self.rows[rows], centroids)
        d[~np.repeat(left, np.diff(at)[nodes], axis=0)] = np.iinfo(np.int64).max
        for row, cluster in zip(rows.tolist(), d.argmin(axis=1).tolist(), strict=True):  # of equal distances the first
            yield -1, row, row + 1, cluster


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < PLAIN:
        a, b = rows.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)


FIELDS = ("rows", "radius", "count", "total")


def trees(points: DataFrame, size: int) -> DataFrame:
    """(ids, rows, radius, count, total): one row for each tree of points (id, x); about TREE vectors are in memory at a time."""

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            order, tree = Balls.packed(rows)
            ids = batch.column(0).take(pa.array(order))
            values = [tree.rows.ravel().astype(np.int32), tree.radius, tree.count, tree.total.ravel()]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([v]) for v in values]], ["ids", *FIELDS])

        held: list[pa.RecordBatch] = []
        for batch in found:
            held.append(batch)
            if sum(b.num_rows for b in held) < TREE:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            full = whole.num_rows // TREE * TREE
            for at in range(0, full, TREE):
                yield one(whole.slice(at, TREE))
            held = [whole.slice(full)] if full < whole.num_rows else []
        if sum(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    types = [T.ArrayType(points.schema["id"].dataType), T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]
    return points.mapInArrow(batches, T.StructType([T.StructField(*x) for x in zip(("ids", *FIELDS), types, strict=True)]))


def read_trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Balls]]:
    at = {name: batch.schema.get_field_index(name) for name in ("ids", *FIELDS)}
    for k in range(batch.num_rows):
        rows, radius, count, total = (batch.column(at[name])[k].values.to_numpy(zero_copy_only=False) for name in FIELDS)
        yield batch.column(at["ids"])[k].values, Balls(rows.astype(np.int64).reshape(-1, size), radius, count, total.reshape(-1, size))


def sums(packed: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sum of every (cluster, component) over all vectors, and the number of vectors as the component after the last."""
    size = centroids.shape[1]

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(centroids), size + 1), np.int64)
        for batch in found:
            for _, tree in read_trees(batch, size):
                for node, first, end, cluster in tree.assigned(centroids):
                    out[cluster, :size] += tree.rows[first] if node < 0 else tree.total[node]
                    out[cluster, size] += end - first
        k, i = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(out.ravel())], ["cluster", "component", "total"])

    parts = packed.mapInArrow(batches, "cluster int, component int, total long")
    found = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # centroids x (size + 1) rows
    return {(r["cluster"], r["component"]): int(r["total"]) for r in found}


def moved(centroids: np.ndarray, found: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    size = centroids.shape[1]
    return np.array([[found[k, i] // found[k, size] for i in range(size)] if found.get((k, size)) else c.tolist() for k, c in enumerate(centroids)], np.int64)


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly size components, none null or not finite; others are left out.

    Components are floor(scale * x). Centroids start as the k vectors with the
    smallest sha256 of salt and id (of equal ones those with smaller components; a
    null id counts as empty) and are moved rounds times; when they stand still, later
    rounds would change nothing and are left out. distance is squared; of centroids
    equally far the first counts. Repeated rows are vectors of their own. With fewer
    than k vectors there are fewer clusters; an empty table gives an empty one.
    Components of 2**27 or more are an error. Other columns are ignored.
    """
    points = vectors.select(F.col(id_col).alias("id"), components(F.col(vec_col), size, scale).alias("x")).where("x is not null")
    first = points.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, size)
    packed = staged(trees(points, size), "trees")
    for _ in range(rounds if len(first) else 0):
        before, centroids = centroids, moved(centroids, sums(packed, centroids))
        if (before == centroids).all():
            break

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for ids, tree in read_trees(batch, size):
                cluster = np.zeros(len(ids), np.int32)
                for _, a, b, c in tree.assigned(centroids):
                    cluster[a:b] = c
                distance = ((tree.rows - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", points.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    done = staged(packed.mapInArrow(batches, schema), "clustered")
    drop_staged(packed)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return done.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of([inertia.get(c, 0) for c in range(len(first))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], "string").alias("centroid_sha256"),
    )


def sql(rounds: int = ROUNDS) -> str:
    """The query's rows, round by round."""
    parts = [
        """v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), x) - 1 as c, x as m from v order by c limit 8)",
    ]
    d = "cast(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, min(struct_pack(d := {d}, c := c)) as best from v, c{i} group by r)")
        if i < rounds:
            parts.append(f"""s{i} as materialized (select c, i, cast(sum(y) as bigint) as s, count(*) as n from (select best.c as c, unnest(x) as y, unnest(range(64)) as i from a{i} join v using (r)) group by c, i)""")
            parts.append(f"""c{i + 1} as materialized (select c{i}.c as c, coalesce(n.m, c{i}.m) as m from c{i} left join
(select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{i} group by c) as n on n.c = c{i}.c)""")
    last = f"a{rounds}"
    return f"""with {', '.join(parts)}
select vec_id, cast(best.c as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
sha256(array_to_string(m, ',')) as centroid_sha256 from {last} join v using (r) join c{rounds} on c{rounds}.c = best.c"""


SQL = sql()
