"""Positions: single-point solutions as window sums, and a filter of the precise kind over many receivers at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

Names = Sequence[str]
#: Satellites that a position and a clock need.
LEAST = 4
#: Length unit (m) of the closed solution, and a radius of the Earth (m) to choose between its two roots.
LARGE, EARTH = 1e7, 6.371e6
#: Names of a symmetric 4 x 4 matrix, by rows of its upper half.
UPPER = [(i, j) for i in range(4) for j in range(i, 4)]


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def solved(df: DataFrame, matrix: str, right: str, out: Names) -> DataFrame:
    """df with the solution of a symmetric 4 x 4 system, by elimination; null where it has none.

    Columns matrix_ij hold the upper half, right_i the right side. Each step is a
    projection of its own, so that nothing is worked out twice.
    """
    m, b = (lambda i, j: F.col(f"{matrix}_{min(i, j)}{max(i, j)}")), (lambda i: F.col(f"{right}_{i}"))
    d, low = (lambda i: F.col(f"_d{i}")), (lambda i, j: F.col(f"_l{i}{j}"))
    for j in range(4):
        df = df.withColumn(f"_d{j}", m(j, j) - sum((low(j, k) * low(j, k) * d(k) for k in range(j)), F.lit(0.0)))
        df = df.withColumns({f"_l{i}{j}": over(m(i, j) - sum((low(i, k) * low(j, k) * d(k) for k in range(j)), F.lit(0.0)), d(j)) for i in range(j + 1, 4)})
        df = df.withColumn(f"_y{j}", b(j) - sum((low(j, k) * F.col(f"_y{k}") for k in range(j)), F.lit(0.0)))
    for i in reversed(range(4)):
        df = df.withColumn(out[i], over(F.col(f"_y{i}"), d(i)) - sum((low(k, i) * F.col(out[k]) for k in range(i + 1, 4)), F.lit(0.0)))
    return df.drop(*[f"_{x}{i}" for x in "dy" for i in range(4)], *[f"_l{i}{j}" for j in range(4) for i in range(j + 1, 4)])


def summed(df: DataFrame, keys: Names, sums: dict[str, Column]) -> DataFrame:
    """df with sums over the rows of its keys; one shuffle serves all that follow each other."""
    w = Window.partitionBy(*keys)
    return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})


def closed_positions(obs: DataFrame, keys: Names, code: str, place: Names, out: Names) -> DataFrame:
    """obs with the closed solution of code = |place - x| + clock for each of keys: x, y, z and clock in metres; null with fewer than four codes."""
    s = [F.col(c) / LARGE for c in (*place, code)]
    there = F.col(code).isNotNull() & F.col(place[0]).isNotNull()
    half = (s[0] * s[0] + s[1] * s[1] + s[2] * s[2] - s[3] * s[3]) / 2
    part = lambda c: F.when(there, c)
    df = summed(obs, keys, {f"_m_{i}{j}": part(s[i] * s[j]) for i, j in UPPER} | {f"_u_{i}": part(s[i]) for i in range(4)} | {f"_v_{i}": part(s[i] * half) for i in range(4)} | {"_n": part(F.lit(1))})
    df = solved(solved(df, "_m", "_u", [f"_p{i}" for i in range(4)]), "_m", "_v", [f"_q{i}" for i in range(4)])
    p, q = [F.col(f"_p{i}") for i in range(4)], [F.col(f"_q{i}") for i in range(4)]
    product = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2] - a[3] * b[3]
    df = df.withColumns({"_a": product(p, p), "_b": product(p, q) - 1, "_c": product(q, q)})
    df = df.withColumn("_root", F.sqrt(F.greatest(F.col("_b") * F.col("_b") - F.col("_a") * F.col("_c"), F.lit(0.0))))
    df = df.withColumns({"_f": over(-F.col("_b") + F.col("_root"), F.col("_a")), "_g": over(-F.col("_b") - F.col("_root"), F.col("_a"))})
    off = lambda k: F.abs(F.sqrt(sum(((p[i] * F.col(k) + q[i]) * (p[i] * F.col(k) + q[i]) for i in range(3)), F.lit(0.0))) * LARGE - EARTH)
    df = df.withColumn("_k", F.when(off("_f") <= off("_g"), F.col("_f")).otherwise(F.col("_g")))
    sign = (1.0, 1.0, 1.0, -1.0)
    df = df.withColumns({name: F.when(F.col("_n") >= LEAST, (p[i] * F.col("_k") + q[i]) * (LARGE * sign[i])) for i, name in enumerate(out)})
    return df.drop("_a", "_b", "_c", "_root", "_f", "_g", "_k", "_n", *[f"_m_{i}{j}" for i, j in UPPER], *[f"_{x}{i}" for x in ("u_", "v_", "p", "q") for i in range(4)])


def position_step(obs: DataFrame, keys: Names, code: str, place: Names, state: Names, weight: Column | float = 1.0, used: Column | None = None) -> DataFrame:
    """obs with state (x, y, z, clock; m) moved by one step of weighted least squares over the rows of keys, and residual, the code less its model before the step.

    Rows that are not used, or lack a value, take no part. With fewer than four rows, or all in one plane, state becomes null.
    """
    x, y, z, clock = (F.col(c) for c in state)
    df = obs.withColumn("_rho", F.sqrt(sum(((F.col(p) - c) * (F.col(p) - c) for p, c in zip(place, (x, y, z), strict=True)), F.lit(0.0))))
    df = df.withColumns({f"_e{i}": over(c - F.col(p), F.col("_rho")) for i, (p, c) in enumerate(zip(place, (x, y, z), strict=True))})
    df = df.withColumn("residual", F.col(code) - F.col("_rho") - clock)
    w = F.when((F.lit(True) if used is None else used) & F.col("residual").isNotNull(), F.lit(weight) if isinstance(weight, (int, float)) else weight)
    df = df.withColumn("_w", w)
    e = [F.col("_e0"), F.col("_e1"), F.col("_e2"), F.lit(1.0)]
    df = summed(df, keys, {f"_m_{i}{j}": F.col("_w") * e[i] * e[j] for i, j in UPPER} | {f"_r_{i}": F.col("_w") * e[i] * F.col("residual") for i in range(4)} | {"_n": F.when(F.col("_w") > 0, 1)})
    df = solved(df, "_m", "_r", [f"_s{i}" for i in range(4)])
    df = df.withColumns({name: F.when(F.col("_n") >= LEAST, F.col(name) + F.col(f"_s{i}")) for i, name in enumerate(state)})
    return df.drop("_rho", "_w", "_n", *[f"_e{i}" for i in range(3)], *[f"_m_{i}{j}" for i, j in UPPER], *[f"_{x}{i}" for x in ("r_", "s") for i in range(4)])


def positions(obs: DataFrame, keys: Names, code: str = "p", place: Names = ("sx", "sy", "sz"), weight: Column | float = 1.0, steps: int = 3, outliers: int = 2, limit: float = 3.0, noise: float = 1.5) -> DataFrame:
    """obs with x, y, z, clock_m (m), residual_m, used and sigma_m of each of keys (station and epoch), by iterated least squares from the closed solution.

    Satellites' places are in the frame at reception, codes are freed of their clocks.
    After steps the row without which the sum of squares falls most goes if its residual,
    as seen from the others, exceeds limit times their deviation and that of codes of
    weight one (noise, m); outliers times at most, as long as more than five rows are left, each
    time followed by two steps. sigma_m is the deviation of unit weight, null without a row to
    spare. Null places and codes take no part and have no residual. All windows have the same keys,
    so rows are shuffled once; a group is one receiver's epoch.
    """
    state = ["x", "y", "z", "clock_m"]
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    over_keys = Window.partitionBy(*keys)
    df = closed_positions(obs, keys, code, place, state).withColumn("used", F.col(code).isNotNull() & F.col(place[0]).isNotNull())
    for _ in range(steps):
        df = position_step(df, keys, code, place, state, w, F.col("used"))
    for k in range(outliers + 1):
        rho = F.sqrt(sum(((F.col(p) - F.col(c)) * (F.col(p) - F.col(c)) for p, c in zip(place, state[:3], strict=True)), F.lit(0.0)))
        df = df.withColumn("_rho", rho).withColumn("residual_m", F.col(code) - F.col("_rho") - F.col("clock_m"))
        live = F.when(F.col("used"), w * F.col("residual_m") * F.col("residual_m"))
        df = df.withColumns({"_square": F.sum(live).over(over_keys), "_n": F.count(live).over(over_keys)})
        df = df.withColumn("sigma_m", F.when(F.col("_n") > LEAST, F.sqrt(F.col("_square") / (F.col("_n") - LEAST))))
        if k < outliers:
            # What the sum of squares would lose with each row: its own square, and more the better the position follows it.
            df = df.withColumns({f"_a_{i}": over(F.col(c) - F.col(p), F.col("_rho")) for i, (p, c) in enumerate(zip(place, state[:3], strict=True))}).withColumn("_a_3", F.lit(1.0))
            df = summed(df, keys, {f"_m_{i}{j}": F.when(F.col("used"), w * F.col(f"_a_{i}") * F.col(f"_a_{j}")) for i, j in UPPER})
            df = solved(df, "_m", "_a", [f"_s{i}" for i in range(4)])
            own = 1 - w * sum((F.col(f"_a_{i}") * F.col(f"_s{i}") for i in range(4)), F.lit(0.0))
            df = df.withColumn("_loss", F.when(own > 1e-9, live / own)).withColumn("_worst", F.max("_loss").over(over_keys))
            rest = F.greatest((F.col("_square") - F.col("_worst")) / F.greatest(F.col("_n") - LEAST - 1, F.lit(1)), F.lit(noise * noise))
            gone = (F.col("_n") > LEAST + 1) & (F.col("_worst") > limit * limit * rest) & (F.col("_loss") == F.col("_worst"))
            df = df.withColumn("used", F.col("used") & ~F.coalesce(gone, F.lit(False)))
            df = df.drop("_loss", "_worst", *[f"_m_{i}{j}" for i, j in UPPER], *[f"_{x}{i}" for x in ("a_", "s") for i in range(4)])
            for _ in range(2):
                df = position_step(df, keys, code, place, state, w, F.col("used"))
        df = df.drop("_square", "_n", "_rho")
    return df.drop("residual")


@dataclass(frozen=True)
class Noise:
    """Deviations in metres: of codes and phases at the zenith, of first values, and what is added in a second (square metres)."""

    code: float = 0.6
    phase: float = 0.006
    place: float = 10.0
    clock: float = 100.0
    system: float = 30.0
    wet: float = 0.2
    slant: float = 20.0
    ambiguity: float = 60.0
    place_rate: float = 0.0
    system_rate: float = 1e-8
    wet_rate: float = 3e-9
    ambiguity_rate: float = 0.0


FIELDS = ("code1", "code2", "phase1", "phase2", "ex", "ey", "ez", "wet", "ratio", "elevation")
RESULTS = ("dx", "dy", "dz", "clock_m", "wet_m", "slant_m", "slant_sd", "ambiguity1_m", "ambiguity2_m")


def updated(x: np.ndarray, p: np.ndarray, h: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and covariances after measurements y = h x + noise of variance r, all stacked by receiver."""
    hp = h @ p
    s = hp @ h.transpose(0, 2, 1)
    i = np.arange(s.shape[1])
    s[:, i, i] += r
    gain = np.linalg.solve(s, hp).transpose(0, 2, 1)
    x = x + (gain @ (y - (h @ x[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
    left = -(gain @ h)
    j = np.arange(left.shape[1])
    left[:, j, j] += 1
    p = left @ p @ left.transpose(0, 2, 1) + (gain * r[:, None, :]) @ gain.transpose(0, 2, 1)
    return x, (p + p.transpose(0, 2, 1)) / 2


class Receivers:
    """Filters of many receivers, side by side. A state is place, clock, a bias of each further system, wet delay, and for every satellite in sight slant delay and two ambiguities.

    Clock and slant delays start anew each epoch. A satellite's ambiguities leave
    with it, and start anew where a slip is marked and after it was thrown out.
    """

    #: Receivers whose matrices are handled at a time.
    TOGETHER = 64

    def __init__(self, systems: str, noise: Noise, limit: float):
        self.systems, self.noise, self.limit = systems, noise, limit
        self.wet = 3 + len(systems)
        self.size, self.number = 8, {}
        self.x, self.p, self.seen = np.zeros((0, self.wet + 25)), np.zeros((0, self.wet + 25, self.wet + 25)), np.zeros(0)
        self.slots: list[dict[str, int]] = []

    def at(self, kind: int, slot: int | np.ndarray) -> int | np.ndarray:
        """Index in the state: kind 0 slant delay, 1 and 2 ambiguities."""
        return self.wet + 1 + 3 * slot + kind

    def room(self, receivers: int, satellites: int) -> None:
        if satellites > self.size:
            more = self.size
            while satellites > more:
                more += 8
            add = 3 * (more - self.size)
            self.x, self.p, self.size = np.pad(self.x, ((0, 0), (0, add))), np.pad(self.p, ((0, 0), (0, add), (0, add))), more
        if receivers > len(self.x):
            add = max(receivers, 2 * len(self.x)) - len(self.x)
            self.x, self.p, self.seen = np.pad(self.x, ((0, add), (0, 0))), np.pad(self.p, ((0, add), (0, 0), (0, 0))), np.pad(self.seen, (0, add), constant_values=np.nan)

    def receiver(self, station: object) -> int:
        k = self.number.setdefault(station, len(self.number))
        if k == len(self.slots):
            self.slots.append({})
            self.room(k + 1, self.size)
            first = np.zeros(self.x.shape[1])
            first[:3], first[3], first[4 : self.wet], first[self.wet] = self.noise.place**2, self.noise.clock**2, self.noise.system**2, self.noise.wet**2
            self.x[k], self.p[k], self.seen[k] = 0, np.diag(first), np.nan
        return k

    def renewed(self, k: np.ndarray, i: np.ndarray, value: np.ndarray | float, variance: float) -> None:
        """States i of receivers k lose what ties them to others."""
        self.p[k, i, :] = 0
        self.p[k, :, i] = 0
        self.p[k, i, i] = variance
        self.x[k, i] = value

    def epoch(self, t: float, rows: list[tuple[object, list[str], np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """rows: station, satellites, values in FIELDS, slip of each receiver's satellites at time t; gives values in RESULTS and used of each."""
        done = []
        for at in range(0, len(rows), self.TOGETHER):
            done += self.some(t, rows[at : at + self.TOGETHER])
        return done

    def some(self, t: float, rows: list[tuple[object, list[str], np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(np.full((len(s), len(RESULTS)), np.nan), np.zeros(len(s), bool)) for _, s, _, _ in rows]
        fit = []
        for _, sats, v, _ in rows:
            whole = np.isfinite(v).all(axis=1) & (v[:, 9] > 0) & np.array([s != "" and s[0] in self.systems for s in sats], bool)
            _, first = np.unique(sats, return_index=True)
            fit.append(np.flatnonzero(whole & np.isin(np.arange(len(sats)), first)))  # of repeated satellites the first row
        able = [b for b in range(len(rows)) if len(fit[b]) >= LEAST]
        if not able:
            return out
        k = np.array([self.receiver(rows[b][0]) for b in able])
        many = max(len(fit[b]) for b in able)
        slot = np.zeros((len(able), many), int)
        fresh: list[tuple[int, int, float, float]] = []
        for n, b in enumerate(able):
            _, sats, v, slip = rows[b]
            held = self.slots[k[n]]
            here = [sats[i] for i in fit[b]]
            for gone in held.keys() - set(here):
                del held[gone]
            free = iter(sorted(set(range(len(here))) - set(held.values())))
            for m, i in enumerate(fit[b]):
                if sats[i] not in held or slip[i]:
                    held.setdefault(sats[i], -1)
                    if held[sats[i]] < 0:
                        held[sats[i]] = next(free)
                    fresh.append((k[n], held[sats[i]], v[i, 2] - v[i, 0], v[i, 3] - v[i, 1]))
                slot[n, m] = held[sats[i]]
        self.room(0, int(slot.max()) + 1)
        if fresh:
            kk, ss, one, two = (np.array(c) for c in zip(*fresh, strict=True))
            self.renewed(kk, self.at(1, ss), one, self.noise.ambiguity**2)
            self.renewed(kk, self.at(2, ss), two, self.noise.ambiguity**2)
        # What time adds; a first epoch adds nothing.
        dt = np.nan_to_num(t - self.seen[k])[:, None]
        i = np.arange(self.x.shape[1])
        rate = np.zeros(len(i))
        rate[:3], rate[4 : self.wet], rate[self.wet] = self.noise.place_rate, self.noise.system_rate, self.noise.wet_rate
        rate[self.at(1, np.arange(self.size))] = rate[self.at(2, np.arange(self.size))] = self.noise.ambiguity_rate
        self.p[k[:, None], i, i] += rate * dt
        h, y, r = np.zeros((len(able), many, 4, len(i))), np.zeros((len(able), many, 4)), np.ones((len(able), many, 4))
        level = np.zeros(len(able))
        for n, b in enumerate(able):
            v, m = rows[b][2][fit[b]], len(fit[b])
            level[n] = v[:, 0].mean()
            h[n, :m, :, :3] = -v[:, None, 4:7]
            h[n, :m, :, 3] = 1
            for j, s in enumerate(rows[b][1][i] for i in fit[b]):
                if s[0] != self.systems[0]:
                    h[n, j, :, 3 + self.systems.index(s[0])] = 1
            h[n, :m, :, self.wet] = v[:, None, 7]
            which, one = np.arange(m), np.ones(m)
            h[n, which, :, self.at(0, slot[n, :m])] = np.stack([one, v[:, 8], -one, -v[:, 8]], axis=1)
            h[n, which, 2, self.at(1, slot[n, :m])] = 1
            h[n, which, 3, self.at(2, slot[n, :m])] = 1
            y[n, :m] = v[:, :4]
            r[n, :m] = (np.array([self.noise.code, self.noise.code, self.noise.phase, self.noise.phase]) / np.sin(v[:, 9])[:, None]) ** 2
        self.renewed(k, np.full(len(k), 3), level, self.noise.clock**2)
        ks, ms = np.nonzero(np.arange(many) < np.array([len(fit[b]) for b in able])[:, None])
        self.renewed(k[ks], self.at(0, slot[ks, ms]), 0.0, self.noise.slant**2)
        alive = np.arange(many) < np.array([len(fit[b]) for b in able])[:, None]
        x, p = self.x[k], self.p[k]
        todo = np.arange(len(able))
        while len(todo):
            on = alive[todo][:, :, None]
            hh = (h[todo] * on[..., None]).reshape(len(todo), -1, len(i))
            yy, rr = (y[todo] * on).reshape(len(todo), -1), np.where(on, r[todo], 1.0).reshape(len(todo), -1)
            x[todo], p[todo] = updated(self.x[k[todo]], self.p[k[todo]], hh, yy, rr)
            off = yy - (hh @ x[todo][:, :, None])[:, :, 0]
            spread = np.einsum("bmi,bmi->bm", hh @ p[todo], hh) + rr
            worst = (np.abs(off) / np.sqrt(spread)).reshape(len(todo), many, 4).max(axis=2)
            where = worst.argmax(axis=1)
            bad = (worst.max(axis=1) > self.limit) & (alive[todo].sum(axis=1) > LEAST)
            alive[todo[bad], where[bad]] = False
            todo = todo[bad]
        self.x[k], self.p[k], self.seen[k] = x, p, t
        for n, b in enumerate(able):
            m = np.flatnonzero(alive[n, : len(fit[b])])
            to, at = fit[b][m], slot[n, m]
            values, used = out[b]
            used[to] = True
            values[:, :3], values[:, 3], values[:, 4] = x[n, :3], x[n, 3], x[n, self.wet]
            values[to, 5], values[to, 6] = x[n, self.at(0, at)], np.sqrt(p[n, self.at(0, at), self.at(0, at)])
            values[to, 7], values[to, 8] = x[n, self.at(1, at)], x[n, self.at(2, at)]
            for j in set(range(len(fit[b]))) - set(m.tolist()):
                del self.slots[k[n]][rows[b][1][fit[b][j]]]
        return out


def filtered_positions(obs: DataFrame, station: str = "station", time: str = "t", sat: str = "sat", slip: str = "slip", systems: str = "GECR", noise: Noise = Noise(), limit: float = 4.0) -> DataFrame:
    """obs with RESULTS and used: each receiver's place, clock and wet delay at every epoch, and slant delay on the first carrier and ambiguities of its satellites, all in metres.

    obs has codes and phases less their model (m), the unit vector to the satellite
    ex, ey, ez, the mapping factor wet of the wet delay, ratio, the square of the
    carriers' ratio f1 / f2, elevation (rad), and slip, true where a phase starts anew.
    The first of systems has no bias of its own; satellites of others take no part,
    nor do rows that lack a value or stand at the horizon or below. An epoch with fewer than four satellites
    changes nothing and has no results. As long as a residual exceeds limit times its deviation,
    the satellite with the largest goes and the epoch is filtered again.

    Receivers are dealt out; within a partition rows are sorted by time, so that all
    its receivers go forward together and a task holds one state each, not their rows.
    """

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        receivers = Receivers(systems, noise, limit)

        def handled(pdf: pd.DataFrame) -> pd.DataFrame:
            values, names = pdf[list(FIELDS)].to_numpy(float), pdf[sat].fillna("").tolist()
            slips, who, when = pdf[slip].fillna(False).to_numpy(bool), pdf[station].tolist(), pdf[time].to_numpy(float)
            new = np.ones(len(pdf), bool)
            new[1:] = np.array([a != b for a, b in zip(who, who[1:])], bool) | (when[1:] != when[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(pdf))
            out, used = np.full((len(pdf), len(RESULTS)), np.nan), np.zeros(len(pdf), bool)
            at = 0
            while at < len(starts):
                last = at
                while last < len(starts) and when[starts[last]] == when[starts[at]]:
                    last += 1
                spans = [slice(a, b) for a, b in zip(starts[at:last], ends[at:last], strict=True)]
                for s, (v, u) in zip(spans, receivers.epoch(when[starts[at]], [(who[s.start], names[s], values[s], slips[s]) for s in spans]), strict=True):
                    out[s], used[s] = v, u
                at = max(last, at + 1)
            return pdf.assign(**{name: out[:, j] for j, name in enumerate(RESULTS)}, used=used)

        held = None
        for pdf in found:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[time].to_numpy(float)
            cut = len(pdf) - int((last == last[-1])[::-1].argmin()) if (last != last[-1]).any() else 0
            if cut:
                yield handled(pdf.iloc[:cut])
            held = pdf.iloc[cut:]
        if held is not None and len(held):
            yield handled(held)

    schema = T.StructType([*obs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in RESULTS], T.StructField("used", T.BooleanType())])
    return obs.where(F.col(time).isNotNull()).repartition(station).sortWithinPartitions(time, station, sat).mapInPandas(batches, schema)
