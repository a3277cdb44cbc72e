import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tecflow.operators import positioning as P

RATIO = (1575.42 / 1227.60) ** 2


def sky(rng, n):
    """Unit vectors up from the x axis, with elevations."""
    el, az = rng.uniform(0.2, 1.5, n), rng.uniform(0, 2 * np.pi, n)
    return np.stack([np.sin(el), np.cos(el) * np.cos(az), np.cos(el) * np.sin(az)], axis=1), el


def epochs(seed, stations=3, count=25, gross=True):
    """Rows for filtered_positions with the truth: satellites come and go, phases slip, a code is spoilt now and then."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for s in range(stations):
        place, systems = rng.normal(0, 2, 3), {"G": 0.0, "E": 3.0}
        amb = {}
        for k in range(count):
            t = 30.0 * k + (15.0 if s == 2 else 0.0)
            clock = rng.normal(0, 40)
            here = [f"{'GE'[i % 2]}{i:02d}" for i in range(14) if (k // 6 + i + s) % 4]
            if k == 9 and s == 1:
                here = here[:3]
            e, el = sky(rng, len(here))
            for sat, u, a in zip(here, e, el, strict=True):
                slip = sat not in amb or rng.random() < 0.03
                if slip:
                    amb[sat] = rng.normal(0, 20, 2)
                slant, wet = 3 + 2 / math.sin(a), 1 / math.sin(a)
                common = -(u @ place) + clock + systems[sat[0]] + 0.12 * wet
                code = [common + slant + rng.normal(0, 0.3), common + RATIO * slant + rng.normal(0, 0.3)]
                phase = [common - slant + amb[sat][0] + rng.normal(0, 0.003), common - RATIO * slant + amb[sat][1] + rng.normal(0, 0.003)]
                if gross and rng.random() < 0.01:
                    code[0] += 60
                rows.append((f"S{s}", t, sat, *map(float, code), *map(float, phase), *map(float, u), wet, RATIO, float(a), bool(slip)))
                truth[f"S{s}", t, sat] = slant
            for gone in set(amb) - set(here):
                del amb[gone]
    return rows, truth


SCHEMA = "station string, t double, sat string, code1 double, code2 double, phase1 double, phase2 double, ex double, ey double, ez double, wet double, ratio double, elevation double, slip boolean"


def plain(rows, noise=P.Noise(), systems="GE", limit=4.0):
    """One receiver after the other, with matrices of just the unknowns at hand."""
    out = {}
    for station in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == station]
        names = ["x", "y", "z", "clock", *[f"b{s}" for s in systems[1:]], "wet"]
        x = np.zeros(len(names))
        p = np.diag([noise.place**2] * 3 + [noise.clock**2] + [noise.system**2] * (len(systems) - 1) + [noise.wet**2])
        before = None

        def drop(name):
            nonlocal x, p, names
            i = names.index(name)
            x, p = np.delete(x, i), np.delete(np.delete(p, i, 0), i, 1)
            names = names[:i] + names[i + 1 :]

        def add(name, value, variance):
            nonlocal x, p, names
            if name in names:
                drop(name)
            x, p = np.append(x, value), np.pad(p, ((0, 1), (0, 1)))
            p[-1, -1] = variance
            names = [*names, name]

        for t in sorted({r[1] for r in mine}):
            now = {r[2]: r for r in sorted(mine, key=lambda r: r[2]) if r[1] == t and all(map(math.isfinite, r[3:13])) and r[12] > 0}
            if len(now) < 4:
                continue
            for n in [n for n in names if n[:2] in ("N1", "N2") and n[2:] not in now]:
                drop(n)
            for s, r in now.items():
                if f"N1{s}" not in names or r[13]:
                    add(f"N1{s}", r[5] - r[3], noise.ambiguity**2)
                    add(f"N2{s}", r[6] - r[4], noise.ambiguity**2)
            dt = 0 if before is None else t - before
            for i, n in enumerate(names):
                p[i, i] += dt * (noise.wet_rate if n == "wet" else noise.system_rate if n[0] == "b" else noise.place_rate if n in "xyz" else 0)
            add("clock", np.mean([r[3] for r in now.values()]), noise.clock**2)
            for s in now:
                add(f"I{s}", 0.0, noise.slant**2)
            alive = set(now)
            while True:
                h, y, v = [], [], []
                for s in sorted(alive):
                    r = now[s]
                    for j in range(4):
                        row = np.zeros(len(names))
                        row[[names.index(c) for c in "xyz"]] = [-c for c in r[7:10]]
                        row[names.index("clock")], row[names.index("wet")] = 1, r[10]
                        if s[0] != systems[0]:
                            row[names.index(f"b{s[0]}")] = 1
                        row[names.index(f"I{s}")] = (1, r[11], -1, -r[11])[j]
                        if j > 1:
                            row[names.index(f"N{j - 1}{s}")] = 1
                        h.append(row)
                        y.append(r[3 + j])
                        v.append(((noise.code, noise.code, noise.phase, noise.phase)[j] / math.sin(r[12])) ** 2)
                h, y, v = np.array(h), np.array(y), np.array(v)
                gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(v))
                xn = x + gain @ (y - h @ x)
                left = np.eye(len(x)) - gain @ h
                pn = left @ p @ left.T + gain @ np.diag(v) @ gain.T
                score = np.abs(y - h @ xn) / np.sqrt(np.diag(h @ pn @ h.T) + v)
                if score.max() <= limit or len(alive) <= 4:
                    break
                alive.remove(sorted(alive)[int(score.argmax()) // 4])
            x, p, before = xn, pn, t
            get = lambda n: x[names.index(n)]
            for s in now:
                own = (get(f"I{s}"), math.sqrt(p[names.index(f"I{s}"), names.index(f"I{s}")]), get(f"N1{s}"), get(f"N2{s}")) if s in alive else (None,) * 4
                out[station, t, s] = (get("x"), get("y"), get("z"), get("clock"), get("wet"), *own, s in alive)
            for s in set(now) - alive:
                drop(f"N1{s}")
                drop(f"N2{s}")
    return out


def results(df):
    return {(r.station, r.t, r.sat): (*(r[c] for c in P.RESULTS), r.used) for r in df.collect()}


@pytest.mark.parametrize("batch", ["10000", "37"])
def test_filter_equals_plain_loops(spark, batch):
    rows, truth = epochs(1)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # epochs are cut by batches, the state goes on
    try:
        got = results(P.filtered_positions(df, systems="GE"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = plain(rows)
    assert set(got) == {(r[0], r[1], r[2]) for r in rows}
    thrown = 0
    for key, g in got.items():
        w = want.get(key)
        if w is None:
            assert g == (None,) * 9 + (False,)
            continue
        thrown += not w[9]
        assert g[9] == w[9]
        for a, b in zip(g[:9], w[:9], strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6)), (key, g, w)
    assert thrown >= 5
    late = [abs(g[5] - truth[key]) for key, g in got.items() if g[9] and key[1] > 400]
    assert np.median(late) < 1.0


def test_filter_of_odd_rows(spark):
    rows, _ = epochs(2, 1, 4, gross=False)
    bad = [(None, 0.0, "G01", *[1.0] * 4, 1.0, 0.0, 0.0, 1.0, RATIO, 0.5, False), ("S0", 0.0, None, *[1.0] * 10, None), ("S0", None, "G01", *[1.0] * 10, True), ("S0", 0.0, "R07", *[1.0] * 10, False), ("S0", 0.0, rows[0][2], *[None] * 10, False)]
    clean = results(P.filtered_positions(spark.createDataFrame(rows, SCHEMA), systems="GE"))
    got = P.filtered_positions(spark.createDataFrame([*rows, *bad, rows[1]], SCHEMA), systems="GE").collect()
    assert len(got) == len(rows) + 5  # all but the row without a time
    assert sum(r.used for r in got) == sum(v[9] for v in clean.values())
    assert P.filtered_positions(spark.createDataFrame([], SCHEMA)).count() == 0

def test_filter_of_lone_rows(spark):
    rows, _ = epochs(2, 1, 4, gross=False)
    for lone in ([rows[0]], [*rows, (*rows[0][:1], 9000.0, *rows[0][2:])]):  # a partition's only row, and a last epoch of one row
        got = P.filtered_positions(spark.createDataFrame(lone, SCHEMA), systems="GE").collect()
        assert len(got) == len(lone)
        assert [(r.used, r.dx) for r in got if r.t == lone[-1][1]] == [(False, None)]


def codes(seed, stations=4, sats=9, spoil=True):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for s in range(stations):
        lat, lon = rng.uniform(-1.5, 1.5), rng.uniform(-3, 3)
        up = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
        here, clock = 6.37e6 * up, rng.normal(0, 3e5)
        for k in range(3):
            n = (3, sats, 4)[k]
            for i in range(n):
                while True:
                    u = rng.normal(size=3)
                    u /= np.linalg.norm(u)
                    if u @ up > 0.1:
                        break
                sat = here + 2.2e7 * u
                p = 2.2e7 + clock + rng.normal(0, 1) + (500 if spoil and k == 1 and i == 2 else 0)
                rows.append((f"S{s}", k, f"G{i:02d}", float(p), *map(float, sat), float(0.2 + u @ up)))
            truth[f"S{s}", k] = (*here, clock)
    return rows, truth


def least(mine, steps=30):
    x = np.zeros(4)
    x[:3] = np.mean([r[4:7] for r in mine], axis=0) * 0.2
    for _ in range(steps):
        s, p, w = np.array([r[4:7] for r in mine]), np.array([r[3] for r in mine]), np.array([r[7] for r in mine])
        rho = np.linalg.norm(s - x[:3], axis=1)
        a = np.column_stack([(x[:3] - s) / rho[:, None], np.ones(len(s))])
        x += np.linalg.lstsq(a * np.sqrt(w)[:, None], (p - rho - x[3]) * np.sqrt(w), rcond=None)[0]
    return x


def test_positions_from_codes(spark):
    rows, truth = codes(3)
    df = spark.createDataFrame([*rows, ("S0", 1, "G77", None, 1.0, 1.0, 1.0, 1.0), ("S9", 0, "G01", 2e7, None, None, None, 1.0)], "station string, t int, sat string, p double, sx double, sy double, sz double, w double")
    closed = {(r.station, r.t): r for r in P.closed_positions(df, ["station", "t"], "p", ("sx", "sy", "sz"), ["x", "y", "z", "c"]).collect()}
    got = P.positions(df, ["station", "t"], weight=F.col("w")).collect()
    assert len(got) == df.count()
    for r in got:
        mine = [q for q in rows if q[:2] == (r.station, r.t) and not (r.t == 1 and q[2] == "G02")]
        if len(mine) < 4:
            assert r.x is None and closed[r.station, r.t].x is None and r.sigma_m is None
            continue
        want = least(mine)
        assert all(abs(a - b) < 1e-4 for a, b in zip((r.x, r.y, r.z, r.clock_m), want, strict=True))
        assert r.used == (r.p is not None and (r.t, r.sat) != (1, "G02"))  # the spoilt code is thrown out
        c = closed[r.station, r.t]
        assert math.dist((c.x, c.y, c.z), truth[r.station, r.t][:3]) < 5000
        if r.t == 1 and r.used:
            assert r.sigma_m < 3 and abs(r.residual_m) < 6


def test_positions_shuffle_once(spark):
    df = spark.createDataFrame(codes(3)[0], "station string, t int, sat string, p double, sx double, sy double, sz double, w double")
    plan = P.positions(df, ["station", "t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_elimination_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(20):
        a = rng.normal(size=(6, 4))
        rows.append([*(float((a.T @ a)[i, j]) for i, j in P.UPPER), *map(float, rng.normal(size=4))])
    names = [f"m_{i}{j}" for i, j in P.UPPER] + [f"r_{i}" for i in range(4)]
    for r in P.solved(spark.createDataFrame(rows, names), "m", "r", list("abcd")).collect():
        m = np.zeros((4, 4))
        for i, j in P.UPPER:
            m[i, j] = m[j, i] = r[f"m_{i}{j}"]
        assert np.allclose([r[c] for c in "abcd"], np.linalg.solve(m, [r[f"r_{i}"] for i in range(4)]))
