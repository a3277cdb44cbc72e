"""Whole-number ambiguities from their float values and covariance, for many groups (a receiver's epoch) at a time.

A group is small by nature: at most a few dozen satellites. Spark deals groups out,
and each is solved exactly: its lattice is reduced first, so that the search for the
two nearest whole vectors is short, and their distances give the ratio test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: How much shorter a swapped column must be for the reduction to swap.
SHORTER = 0.75


def reduced(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangle, z): columns of the upper triangle r combined by the whole, invertible matrix z so that they are short and nearly at right angles."""
    r, n = r.copy(), len(r)
    z, k = np.eye(n, dtype=np.int64), 1
    while k < n:
        for j in range(k - 1, -1, -1):
            times = round(r[j, k] / r[j, j])
            if times:
                r[: j + 1, k] -= times * r[: j + 1, j]
                z[:, k] -= times * z[:, j]
        if r[k - 1, k] ** 2 + r[k, k] ** 2 < SHORTER * r[k - 1, k - 1] ** 2:
            r[:, [k - 1, k]], z[:, [k - 1, k]] = r[:, [k, k - 1]], z[:, [k, k - 1]]
            size = math.hypot(r[k - 1, k - 1], r[k, k - 1])
            c, s = r[k - 1, k - 1] / size, r[k, k - 1] / size
            r[k - 1 : k + 1, k - 1 :] = np.array([[c, s], [-s, c]]) @ r[k - 1 : k + 1, k - 1 :]
            r[k, k - 1] = 0.0
            k = max(k - 1, 1)
        else:
            k += 1
    return r, z


def two_nearest(r: np.ndarray, x: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """The two whole vectors v nearest to x by |r (x - v)| squared, nearest first; r is an upper triangle."""
    n = len(x)
    found: list[tuple[float, np.ndarray]] = []
    v, way, spent, middle = np.zeros(n), np.zeros(n), np.zeros(n + 1), np.zeros(n)
    k = n - 1

    def enter(k: int) -> None:
        middle[k] = x[k] + (r[k, k + 1 :] @ (x[k + 1 :] - v[k + 1 :])) / r[k, k]
        v[k] = round(middle[k])
        way[k] = 1.0 if middle[k] >= v[k] else -1.0

    def onward(k: int) -> None:
        """The next whole number by distance from the middle."""
        v[k] += way[k]
        way[k] = -way[k] - math.copysign(1.0, way[k])

    enter(k)
    while True:
        here = spent[k + 1] + (r[k, k] * (middle[k] - v[k])) ** 2
        if len(found) == 2 and here >= found[1][0]:
            k += 1
            if k == n:
                return found
            onward(k)
        elif k:
            spent[k] = here
            k -= 1
            enter(k)
        else:
            found = sorted([*found, (here, v.copy())], key=lambda f: (f[0], tuple(f[1])))[:2]
            onward(0)


def solved_group(value: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(whole numbers, ratio, success): ratio of the second smallest squared distance to the smallest; chance that rounding one after the other is right."""
    weight = np.linalg.inv(covariance)
    r, z = reduced(np.linalg.cholesky((weight + weight.T) / 2).T)
    near = np.rint(value)
    x = np.linalg.solve(z, value - near)
    first, second = two_nearest(r, x)
    success = math.prod(math.erf(abs(r[i, i]) / (2 * math.sqrt(2))) for i in range(len(r)))
    ratio = second[0] / first[0] if first[0] > 0 else math.inf
    return near.astype(np.int64) + z @ first[1].astype(np.int64), ratio, success


def fixed(groups: DataFrame, keys: Sequence[str], least_ratio: float = 3.0, least: int = 4) -> DataFrame:
    """(keys, name, value, fixed, ratio, success, n): a row for each ambiguity of groups (keys, names, values, covariance row by row).

    The nearest whole vector in the metric of the covariance is found exactly. Where
    the ratio test fails, the ambiguity with the largest variance goes, and the rest
    is tried again, down to least ambiguities (fewer where a group has fewer). fixed
    is null where none passes, and for those that went; n is how many were fixed, ratio and success
    those of the last try. A group with a null, or a covariance that is none, has no fixed values.
    """
    by = list(keys)
    fields = [groups.schema[k] for k in by] + [T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("fixed", T.LongType()), T.StructField("ratio", T.DoubleType()), T.StructField("success", T.DoubleType()), T.StructField("n", T.LongType())]

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for row in pdf.itertuples(index=False):
                names, values = list(row[len(by)]), np.array(row[len(by) + 1], float)
                m = len(names)
                flat = np.array(row[len(by) + 2], float)
                whole, ratio, success, taken = np.full(m, None, object), math.nan, math.nan, 0
                on = np.argsort(np.diag(flat.reshape(m, m)), kind="stable") if flat.size == m * m and len(values) == m else np.zeros(0, int)
                if m and len(on) == m and np.isfinite(flat).all() and np.isfinite(values).all():
                    cov = flat.reshape(m, m)
                    for size in range(m, min(least, m) - 1, -1):
                        use = np.sort(on[:size])
                        try:
                            n, ratio, success = solved_group(values[use], cov[np.ix_(use, use)])
                        except np.linalg.LinAlgError:
                            break
                        if ratio >= least_ratio:
                            whole[use], taken = n, size
                            break
                for i in range(m):
                    out.append((*row[: len(by)], names[i], values[i] if i < len(values) else None, whole[i], ratio, success, taken))
            frame = pd.DataFrame(out, columns=[f.name for f in fields], dtype=object)
            yield frame.astype({"value": float, "ratio": float, "success": float, "fixed": "Int64", "n": "int64"})

    there = F.col("names").isNotNull() & F.col("values").isNotNull() & F.col("covariance").isNotNull()
    return groups.where(there).select(*by, "names", F.col("values").cast("array<double>").alias("values"), F.col("covariance").cast("array<double>").alias("covariance")).mapInPandas(batches, T.StructType(fields))
