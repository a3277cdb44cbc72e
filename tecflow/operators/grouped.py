"""Operators that need a program for each group: filters with memory, arc splitting with feedback, Kalman filters.

A group is one series (an arc, a satellite's day, a station's day), which the
data model bounds; groups are never whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Names = Sequence[str]
#: Rows of whole series that by_series handles together.
HELD = 1 << 16


def poly_of(roots: np.ndarray) -> np.ndarray:
    out = np.array([1.0 + 0j])
    for r in roots:
        out = np.convolve(out, [1, -r])
    return out.real


def bandpass(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth band-pass; low and high as parts of the Nyquist frequency."""
    fast = 4.0
    lo, hi = (2 * fast / 2 * np.tan(np.pi * w / 2) for w in (low, high))
    width, middle = hi - lo, np.sqrt(lo * hi)
    k = np.arange(-order + 1, order, 2)
    base = -np.exp(1j * np.pi * k / (2 * order)) * width / 2
    root = np.sqrt(base**2 - middle**2 + 0j)
    poles = np.concatenate((base + root, base - root))
    zeros = np.zeros(order)
    gain = width**order
    c = fast
    digital_poles, digital_zeros = (c + poles) / (c - poles), np.concatenate(((c + zeros) / (c - zeros), -np.ones(order)))
    gain *= (np.prod(c - zeros) / np.prod(c - poles)).real
    return gain * poly_of(digital_zeros), poly_of(digital_poles)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter memory after an endless input of one."""
    n = len(a) - 1
    shift = np.zeros((n, n))
    shift[:, 0] = -a[1:]
    shift[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - shift, b[1:] - a[1:] * b[0])


def side_by_side(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as the rows of one array, filled up with their last values, and their lengths."""
    size = np.array([len(r) for r in rows])
    return np.stack([np.concatenate((r, np.repeat(r[-1:], size.max() - len(r), axis=0))) for r in rows]), size


#: Values that series side by side may have with their padding, in parts of what they have without, and for which that doesn't matter.
PADDED, SMALL = 2, 1 << 14


def by_length(rows: list[np.ndarray], program: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """program over bands of series of like length: padding at most doubles a band, or stays small."""
    out: list[np.ndarray] = [np.empty(0)] * len(rows)
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    at = 0
    while at < len(order):
        end, held = at, 0
        while end < len(order):
            size = len(rows[order[end]])
            if end > at and size * (end + 1 - at) > max(SMALL, PADDED * (held + size)):
                break
            held, end = held + size, end + 1
        band = order[at:end]
        for k, r in zip(band, program([rows[k] for k in band]), strict=True):
            out[k] = r
        at = end
    return out


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, memory: np.ndarray) -> np.ndarray:
    """Filters all rows of x at once, one step of time after the other; memory: (rows, len(a) - 1)."""
    out, z = np.empty_like(x), memory.copy()
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + b[1:-1] * v[:, None] - a[1:-1] * y[:, None]
        z[:, -1] = b[-1] * v - a[-1] * y
        out[:, i] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, rows: list[np.ndarray], pads: list[int]) -> list[np.ndarray]:
    """Filters each series forwards and backwards; ends are extended by odd reflection."""
    if not rows:
        return []
    wide, size = side_by_side([np.concatenate((2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1])) if p else x for x, p in zip(rows, pads, strict=True)])
    memory = steady_state(b, a)
    forth = filtered(b, a, wide, memory * wide[:, :1])
    turned, _ = side_by_side([r[n - 1 :: -1] if n < len(r) else r[::-1] for r, n in zip(forth, size, strict=True)])
    back = filtered(b, a, turned, memory * turned[:, :1])
    return [r[:n][::-1][p : n - p] for r, n, p in zip(back, size, pads, strict=True)]


def without_trend(x: np.ndarray, degree: int) -> np.ndarray:
    at = np.linspace(-1, 1, len(x))
    return x - np.polynomial.polynomial.polyval(at, np.polynomial.polynomial.polyfit(at, x, degree))


def by_series(df: DataFrame, keys: Names, order: Names, values: Names, out: Names, program: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """df with columns out, from a program for many series at a time: it gets (rows, values) of each and gives (rows, out) of each.

    Rows are dealt out by keys and sorted within their partition, so that a series
    is a run of rows; about HELD rows of whole series are handled together. Only a
    series longer than that is held alone.
    """
    by, columns, out = list(keys), list(values), list(out)

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def handled(pdf: pd.DataFrame) -> pd.DataFrame:
            first = np.flatnonzero(starts(pdf))
            parts = np.split(pdf[columns].to_numpy(float), first[1:])
            new = np.concatenate(program(parts))
            return pdf.assign(**{name: np.where(np.isfinite(new[:, k]), new[:, k], np.nan) for k, name in enumerate(out)})

        def starts(pdf: pd.DataFrame) -> np.ndarray:
            k = pdf[by]
            before = k.shift()
            new = ~((k == before) | (k.isna() & before.isna())).all(axis=1).to_numpy()
            new[0] = True
            return new

        held: list[pd.DataFrame] = []
        for pdf in found:
            held.append(pdf)
            if sum(map(len, held)) >= HELD:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.flatnonzero(starts(whole))[-1])
                if last:
                    yield handled(whole.iloc[:last])
                held = [whole.iloc[last:]]
        if sum(map(len, held)):
            yield handled(pd.concat(held, ignore_index=True))

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in out]])
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(batches, schema)


def band_filtered(df: DataFrame, keys: Names, order: Names, value: str, low: float = 0.001, high: float = 0.015, step: float = 30.0, filter_order: int = 6, out: str = "filtered") -> DataFrame:
    """Zero-phase band-pass of each series (keys: one unbroken arc) after a cubic detrend; null in arcs of up to six times the filter's order."""
    nyquist = 0.5 / step
    b, a = bandpass(filter_order, low / nyquist, high / nyquist)
    least = 6 * filter_order

    def program(series: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.full((len(x), 1), np.nan) for x in series]
        able = [k for k, x in enumerate(series) if len(x) > least and np.isfinite(x).all()]
        done = by_length([without_trend(series[k][:, 0], 3) for k in able], lambda band: zero_phase(b, a, band, [min(3 * len(a), len(x) - 1) for x in band]))
        for k, y in zip(able, done, strict=True):
            found[k][:, 0] = y
        return found

    return by_series(df, keys, order, [value], [out], program)


def split_arcs(lane: np.ndarray, geometry: np.ndarray, least: int, jump: float = 1.0, scatter: float = 4.0, far: float = 5.0) -> np.ndarray:
    """Arc numbers from 0, -1 for rows that are thrown out, of one series without gaps.

    Leading rows that jump are dropped. Then the wide lane's mean and deviation
    run along; a row off by scatter deviations, or a geometry jump of far, ends
    the arc before it. If the row after agrees with it, it starts a new arc; else
    it is thrown out. An arc of fewer than least rows is thrown out whole.
    """
    out, n, number, start = np.full(len(lane), -1), len(lane), 0, 0
    lane, geometry = lane.tolist(), geometry.tolist()  # one value at a time: floats are far faster than items of arrays
    calm = lambda i, j, d: abs(lane[i] - lane[j]) <= d and abs(geometry[i] - geometry[j]) <= d
    while start < n:
        while start + 2 < n and not (calm(start, start + 1, jump) and calm(start + 1, start + 2, jump)):
            start += 1
        mean, square, count, k = lane[start], 0.0, 1, start + 1
        while k < n:
            if count > 1 and not (abs(lane[k] - mean) < scatter * math.sqrt(square) + 1e-12 and abs(geometry[k] - geometry[k - 1]) < far):
                break
            count += 1
            before, mean = mean, mean + (lane[k] - mean) / count
            off = lane[k] - before
            square += (off * off - square) / count
            k += 1
        if k - start >= least:
            out[start:k] = number
            number += 1
        start = k if k + 1 >= n or calm(k, k + 1, jump) else k + 1
    return out


def arcs_by_feedback(df: DataFrame, keys: Names, order: Names, lane: str, geometry: str, least: int = 10, out: str = "arc") -> DataFrame:
    """df with the arc numbers of split_arcs; keys: one series without gaps. Series are short and many, so a batch takes thousands of them."""

    def program(series: list[np.ndarray]) -> list[np.ndarray]:
        return [split_arcs(x[:, 0], x[:, 1], least)[:, None] for x in series]

    return by_series(df, keys, order, [lane, geometry], [out], program).withColumn(out, F.col(out).cast("long"))


def restarted_slips(series: list[np.ndarray], waves: tuple[float, float], back: int, drift: float) -> list[np.ndarray]:
    """(slip, cycles 1, cycles 2) by row, of many arcs at once: wide lane (cycles), geometry-free phase (m) and elevation (degrees) of each row.

    Sums from the arc's start give mean and deviation of any stretch, so that a step
    of time needs no look back but where each arc's stretch begins.
    """
    x, size = side_by_side([np.column_stack([s[:, 0] - s[:, 0].mean(), s[:, 1:]]) for s in series])
    lane, free, elevation = x[..., 0], x[..., 1], x[..., 2]
    rows, n = lane.shape
    one = np.concatenate((np.zeros((rows, 1)), np.cumsum(lane, axis=1)), axis=1)
    two = np.concatenate((np.zeros((rows, 1)), np.cumsum(lane * lane, axis=1)), axis=1)
    each, start, out = np.arange(rows), np.zeros(rows, int), np.zeros((rows, n, 3))

    def stretch(first: np.ndarray, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of rows first to end."""
        count = end - first
        total, square = one[each, end] - one[each, first], two[each, end] - two[each, first]
        mean = total / np.maximum(count, 1)
        return mean, np.sqrt(np.maximum(square - total * mean, 0) / np.maximum(count - 1, 1))

    noise = (2 * (0.0027**2 + 0.0017**2)) ** 0.5
    for i in range(1, n):
        first = np.maximum(start, i - back)
        mean, spread = stretch(first, i)
        young = start == i - 1
        spread = np.where(young, stretch(start, i + 1)[1], spread)
        off = np.maximum(np.abs(mean - lane[:, i]), 1) > 5 * spread
        leap = np.abs(free[:, i - 1] - free[:, i]) > 4 * np.maximum(noise * (1 + 10 * np.exp(-elevation[:, i] / 10)), 0.15) + drift
        slip = ((off & (stretch(start, size)[1] > 0.6)) | leap) & (i < size)
        a, b = lane[:, i - 1] - lane[:, i], free[:, i - 1] - free[:, i]
        n1 = (b - waves[1] * a) / (waves[0] - waves[1])
        cycles = np.rint(np.column_stack([n1, n1 - a]))
        out[:, i, 0] = slip
        out[:, i, 1:] = np.where((slip & (cycles != 0).all(axis=1))[:, None], cycles, 0)
        start = np.where(slip, i, start)
    return [r[:n] for r, n in zip(out, size, strict=True)]


def slips_with_restart(df: DataFrame, keys: Names, order: Names, lane: str, free: str, elevation: str, phases: Names, waves: tuple[float, float], back: int = 30, drift: float = 5 * 30 / 3600) -> DataFrame:
    """df with slip, and fixed1 and fixed2, the phases (m) with the whole cycles of all slips so far of their arc (keys) added.

    A slip is a jump of the geometry-free phase over 0.6 m, or more where noise at that
    elevation and drift allow it; or a wide lane off the mean of up to back rows by over five
    deviations, and by a cycle at least, where the rest of the arc scatters over 0.6. After a slip
    means and deviations start anew. Both lane and geometry-free jump give the cycles; where one
    of them is zero the phases stay. lane is in cycles, elevation in degrees. An arc
    with a value missing is left as it is.
    """

    def program(series: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.zeros((len(x), 3)) for x in series]
        able = [k for k, x in enumerate(series) if np.isfinite(x).all()]
        for k, y in zip(able, by_length([series[k] for k in able], lambda band: restarted_slips(band, waves, back, drift)), strict=True):
            found[k] = y
        return [np.column_stack([y[:, 0], np.cumsum(y[:, 1:], axis=0)]) for y in found]

    done = by_series(df, keys, order, [lane, free, elevation], ["_slip", "_n1", "_n2"], program)
    fixed = {f"fixed{k}": F.col(p) + F.col(f"_n{k}") * wave for k, (p, wave) in enumerate(zip(phases, waves, strict=True), 1)}
    return done.withColumns({"slip": F.col("_slip") > 0, **fixed}).drop("_slip", "_n1", "_n2")


def kalman_levels(series: list[np.ndarray], process: float, noise: float) -> list[np.ndarray]:
    """(level, variance) by row of a random walk seen in noise, for many series at once; gaps only predict."""
    x, size = side_by_side([s[:, 0] for s in series])
    seen = np.isfinite(x)
    start = np.where(seen.any(axis=1), x[np.arange(len(x)), seen.argmax(axis=1)], np.nan)
    out, m, p = np.empty((*x.shape, 2)), start, np.full(len(x), noise)
    for i in range(x.shape[1]):
        p = p + process
        gain = np.where(seen[:, i], p / (p + noise), 0.0)
        m, p = m + gain * np.where(seen[:, i], x[:, i] - m, 0.0), (1 - gain) * p
        out[:, i, 0], out[:, i, 1] = m, p
    return [r[:n] for r, n in zip(out, size, strict=True)]


def kalman(df: DataFrame, keys: Names, order: Names, value: str, process: float, noise: float) -> DataFrame:
    """df with level and variance of each series."""
    return by_series(df, keys, order, [value], ["level", "variance"], lambda series: by_length(series, lambda band: kalman_levels(band, process, noise)))


def trimmed_fit(x: np.ndarray, y: np.ndarray, scatter: float = 3.0, rounds: int = 10) -> np.ndarray:
    """Which points stay when a parabola is fitted again and again without those off by more than scatter deviations."""
    keep = np.isfinite(y)
    for _ in range(rounds):
        if keep.sum() < 5:
            break
        off = y - np.polynomial.polynomial.polyval(x, np.polynomial.polynomial.polyfit(x[keep], y[keep], 2))
        now = np.isfinite(y) & (np.abs(off) <= scatter * max(off[keep].std(), 1e-12))
        if (now == keep).all():
            break
        keep = now
    return keep


def without_outliers(df: DataFrame, keys: Names, order: Names, value: str, scatter: float = 3.0) -> DataFrame:
    """Value, null where it lies off the parabola of its series."""
    first = list(order)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(first)
        y = pdf[value].to_numpy(float)
        return pdf.assign(**{value: np.where(trimmed_fit(np.linspace(-1, 1, len(y)), y, scatter), y, np.nan)})

    return df.groupBy(*keys).applyInPandas(one, df.schema)


def natural_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the cubic spline whose third derivative is steady over the first two and last two intervals, by elimination in one pass."""
    n, h = len(t), np.diff(t)
    d = np.diff(y) / h
    below, main, above, r = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    below[1:-1], main[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    main[0], above[0] = h[1], h[0] + h[1]
    below[-1], main[-1] = h[-1] + h[-2], h[-2]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    for i in range(1, n):
        f = below[i] / main[i - 1]
        main[i] -= f * above[i - 1]
        r[i] -= f * r[i - 1]
    out = r / main
    for i in range(n - 2, -1, -1):
        out[i] = (r[i] - above[i] * out[i + 1]) / main[i]
    return out


def splined(targets: DataFrame, anchors: DataFrame, keys: Names, time: str, values: Names, step: float) -> DataFrame:
    """targets with each value and its rate (name_rate) on the cubic spline through the anchors of their key; null outside and with fewer than four anchors.

    Slopes are worked out once for each key's anchors. An interval between two
    anchors is listed under every stretch of step that it reaches, so a target
    meets its interval by equality, and targets of one key need no common task.
    """
    names, by = list(values), list(keys)
    kept = anchors.select(*by, F.col(time).cast("double").alias("_t"), *[F.col(v).cast("double").alias(v) for v in names]).dropna().dropDuplicates([*by, "_t"])
    new = [f"_{x}_{v}" for v in names for x in ("s", "y", "z")]  # slope here, value and slope at the next anchor

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        if len(pdf) < 4:
            return pdf.assign(_next=0.0, _last=False, **dict.fromkeys(new, 0.0)).iloc[:0]
        t = pdf["_t"].to_numpy()
        out = pdf.iloc[:-1].assign(_next=t[1:], _last=np.arange(1, len(t)) == len(t) - 1)
        for v in names:
            y = pdf[v].to_numpy()
            s = natural_slopes(t, y)
            out[f"_s_{v}"], out[f"_y_{v}"], out[f"_z_{v}"] = s[:-1], y[1:], s[1:]
        return out

    fields = [*kept.schema.fields, T.StructField("_next", T.DoubleType()), T.StructField("_last", T.BooleanType()), *[T.StructField(n, T.DoubleType()) for n in new]]
    spans = kept.groupBy(*by).applyInPandas(one, T.StructType(fields)).withColumnsRenamed({v: f"_v_{v}" for v in names})
    stretch = lambda t: F.floor(F.col(t) / step).cast("long")
    spans = spans.withColumn("_k", F.explode(F.sequence(stretch("_t"), stretch("_next"))))
    at = targets.withColumn("_k", F.floor(F.col(time) / step).cast("long")).withColumn("_at", F.col(time).cast("double"))
    inside = (F.col("_at") >= F.col("_t")) & ((F.col("_at") < F.col("_next")) | (F.col("_last") & (F.col("_at") == F.col("_next"))))
    s = spans.withColumnsRenamed({k: f"_of_{k}" for k in by})
    on = [at[k] == s[f"_of_{k}"] for k in by] + [at["_k"] == s["_k"], inside]
    joined = at.join(s, on, "left")
    x, h = F.col("_at") - F.col("_t"), F.col("_next") - F.col("_t")
    out = []
    for v in names:
        y0, y1, s0, s1 = (F.col(f"_{c}_{v}") for c in "vysz")
        d = (y1 - y0) / h
        c2, c3 = (3 * d - 2 * s0 - s1) / h, (s0 + s1 - 2 * d) / (h * h)
        out += [(y0 + x * (s0 + x * (c2 + x * c3))).alias(v), (s0 + x * (2 * c2 + 3 * x * c3)).alias(f"{v}_rate")]
    return joined.select(*[at[c] for c in targets.columns], *out)
