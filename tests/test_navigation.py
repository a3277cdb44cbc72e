import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tecflow.plans import broadcast as B
from tecflow.sources import navigation as N

DAY = datetime(2024, 3, 24)
WEEK, SOW0 = 2307, 0  # 24 March 2024 is a Sunday


def number(x):
    return f"{x:19.12E}".replace("E", "D")


def elements(rng, sat, hour):
    """A plausible record: numbers in file order."""
    toe = hour * 3600.0
    week = WEEK - (1356 if sat[0] == "C" else 0)
    root = {"G": 5153.6, "E": 5440.6, "C": 6493.4 if int(sat[1:]) < 6 else 5282.6, "J": 6493.0}[sat[0]]
    v = [rng.uniform(-1e-4, 1e-4), rng.uniform(-1e-11, 1e-11), 0.0, 7, rng.uniform(-80, 80), rng.uniform(3e-9, 6e-9), rng.uniform(-3, 3), rng.uniform(-4e-6, 4e-6), rng.choice([0.001, 0.012, 0.16]), rng.uniform(-9e-6, 9e-6), root]
    v += [toe, rng.uniform(-2e-7, 2e-7), rng.uniform(-3, 3), rng.uniform(-2e-7, 2e-7), 0.09 if root > 6400 and sat[0] == "C" else rng.uniform(0.93, 0.98), rng.uniform(150, 300), rng.uniform(-3, 3), rng.uniform(-9e-9, -7e-9), rng.uniform(-3e-10, 3e-10)]
    return [float(f"{x:.12E}") for x in (*v, 0.0, week, 0.0, 2.0, 0.0, 5e-9, 7.0, toe - 7000)]


def plain(sat, v, t):
    """Place by the published rules, one number after the other."""
    gm, we = (3.986004418e14 if sat[0] in "EC" else 3.986005e14), (7.292115e-5 if sat[0] == "C" else 7.2921151467e-5)
    toe = (v[21] + (1356 if sat[0] == "C" else 0)) * 604800 + v[11] + (14 if sat[0] == "C" else 0)
    tk, a, e = t - toe, v[10] ** 2, v[8]
    m = v[6] + (math.sqrt(gm / a**3) + v[5]) * tk
    ea = m
    for _ in range(60):
        ea -= (ea - e * math.sin(ea) - m) / (1 - e * math.cos(ea))
    u = math.atan2(math.sqrt(1 - e * e) * math.sin(ea), math.cos(ea) - e) + v[17]
    s, c = math.sin(2 * u), math.cos(2 * u)
    r, w, i = a * (1 - e * math.cos(ea)) + v[4] * s + v[16] * c, u + v[9] * s + v[7] * c, v[15] + v[19] * tk + v[14] * s + v[12] * c
    still = sat[0] == "C" and int(sat[1:]) in B.STILL
    o = v[13] + (v[18] - (0 if still else we)) * tk - we * v[11]
    p, q = r * math.cos(w), r * math.sin(w)
    xyz = np.array([p * math.cos(o) - q * math.cos(i) * math.sin(o), p * math.sin(o) + q * math.cos(i) * math.cos(o), q * math.sin(i)])
    if still:
        f, z = math.radians(-5), we * tk
        rx = np.array([[1, 0, 0], [0, math.cos(f), math.sin(f)], [0, -math.sin(f), math.cos(f)]])
        rz = np.array([[math.cos(z), math.sin(z), 0], [-math.sin(z), math.cos(z), 0], [0, 0, 1]])
        xyz = rz @ rx @ xyz
    return xyz


def lines(sat, when, v, old=False):
    if old:
        head = f"{int(sat[1:]):2d} {when:%y} {when.month:2d} {when.day:2d} {when.hour:2d} {when.minute:2d}{when.second:5.1f}"
    else:
        head = f"{sat} {when:%Y %m %d %H %M %S}"
    pad = " " * (3 if old else 4)
    return [head + "".join(map(number, v[:3])), *(pad + "".join(map(number, v[k : k + 4])) for k in range(3, len(v), 4))]


def header(version, kind):
    return [f"{version:9.2f}           {kind:<20s}MIXED               RINEX VERSION / TYPE", f"{'made':20s}{'by':20s}{'20240324':20s}PGM / RUN BY / DATE", " " * 60 + "END OF HEADER"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, at, known = random.Random(6), tmp_path_factory.mktemp("nav"), {}
    text = header(3.04, "NAVIGATION DATA")
    for sat in ("G01", "G02", "E05", "C03", "C20", "J02"):
        for hour in (0, 2, 4):
            known[sat, hour] = v = elements(rng, sat, hour)
            text += lines(sat, DAY + timedelta(hours=hour), v)
    sick = elements(rng, "G02", 6)
    sick[24] = 63.0
    text += lines("G02", DAY + timedelta(hours=6), sick)
    again = list(known["G01", 2])
    again[6], again[27] = 1.0, again[27] - 100  # sent earlier: does not count
    text += lines("G01", DAY + timedelta(hours=2), again) + ["G09 2024 03 24 00 00 00 broken"]
    state = {h: [-3e-5, 1e-12, 0, 10000.0 + h, 1.5, 1e-9, 0.0, -15000.0, 2.0, -2e-9, 5.0, 17900.0, 0.9, 0.0, 0.0] for h in (0, 1)}
    for h, v in state.items():
        text += lines("R07", DAY + timedelta(hours=h, minutes=15), v)
    (at / "new.rnx").write_text("\n".join(text))
    old = header(2.11, "N: GPS NAV DATA")
    known["G11", 1] = elements(rng, "G11", 1)
    old += lines("G11", DAY + timedelta(hours=1), known["G11", 1], True)
    (at / "old.24n").write_text("\r\n".join(old))
    return str(at), known, state


def test_records_are_read(spark, files):
    path, known, _ = files
    got = N.read_navigation(spark, f"{path}/*").collect()
    assert len(got) == len(known) + 1
    for r in got:
        hour = round((r.toc_s - WEEK * 604800 - (14 if r.sat[0] == "C" else 0)) / 3600)
        assert r.toe_s == r.toc_s
        if (r.sat, hour) in known:
            v = known[r.sat, hour]
            for name, k in N.ELEMENTS.items():
                if name not in ("toe", "week", "sent"):
                    assert math.isclose(r[name], v[k], rel_tol=1e-11, abs_tol=1e-30), (r.sat, name)
            assert r.toc == DAY + timedelta(hours=hour)
    states = N.read_navigation_states(spark, f"{path}/*").collect()
    assert sorted((r.sat, r.toe_s, r.x, r.channel) for r in states) == [("R07", WEEK * 604800 + h * 3600 + 900 + 18, 1e7 + h * 1000, 5.0) for h in (0, 1)]


def test_choice_and_propagation_equal_plain_rules(spark, files):
    path, known, _ = files
    nav = N.read_navigation(spark, f"{path}/*").cache()
    rng = random.Random(1)
    base = WEEK * 604800.0
    targets = [(s, base + rng.uniform(-4 * 3600, 9 * 3600), i) for i in range(300) for s in ("G01", "G02", "E05", "C03", "C20", "J02", "G11")]
    targets += [("G01", base + 3600.0, 900), ("G01", base - 7200.0, 901), ("G01", base + 4 * 3600 + 7200.0, 902), ("G77", base, 903), (None, base, 904), ("G01", None, 905)]
    df = spark.createDataFrame(targets, "sat string, t double, n int")
    got = B.propagated(B.chosen(df, nav)).collect()
    assert len(got) == len(targets)
    valid = {"G": 7200, "E": 10800, "C": 3600, "J": 3600}
    seen = set()
    for r in got:
        late = 14 if r.sat and r.sat[0] == "C" else 0
        near = [(abs(r.t - base - h * 3600 - late), h) for s, h in known if s == r.sat] if r.t is not None else []
        best = min((x for x in near if x[0] <= valid[r.sat[0]]), default=None)
        if best is None:
            assert r.x is None and r.clock_s is None
            continue
        v = known[r.sat, best[1]]
        seen.add((r.sat, best[1]))
        assert r.toe_s == base + best[1] * 3600 + late
        want = plain(r.sat, v, r.t)
        assert np.abs(np.array([r.x, r.y, r.z]) - want).max() < 1e-5
        speed = (plain(r.sat, v, r.t + 0.5) - plain(r.sat, v, r.t - 0.5))
        assert np.abs(np.array([r.vx, r.vy, r.vz]) - speed).max() < 2e-4
        assert math.isclose(r.clock_s, v[0] + v[1] * (r.t - r.toc_s), rel_tol=1e-9)
    assert seen == set(known)


def test_states_are_integrated(spark, files):
    path, _, state = files
    nav = N.read_navigation_states(spark, f"{path}/*")
    base = WEEK * 604800 + 900 + 18.0
    times = [base + x for x in (-1020.0, -600.5, -30.0, 0.0, 7.25, 999.9, 1020.0, 1800.0, 2580.0, 3600.0, 4620.0, 4621.0)]
    got = B.from_states(spark.createDataFrame([("R07", t) for t in times], "sat string, t double"), nav).orderBy("t").collect()
    for r in got:
        h = min((0, 1), key=lambda h: abs(r.t - base - h * 3600))
        dt = r.t - base - h * 3600
        if abs(dt) > 1020:
            assert r.x is None
            continue
        v = state[h]
        s, fixed = np.array([[v[3], v[7], v[11], v[4], v[8], v[12]]]) * 1000, np.array([[v[5], v[9], v[13]]]) * 1000
        for _ in range(2000):
            s = B.stepped(s, fixed, dt / 2000)
        assert np.abs(np.array([r.x, r.y, r.z]) - s[0, :3]).max() < 1e-3 and np.abs(np.array([r.vx, r.vy, r.vz]) - s[0, 3:]).max() < 1e-4
        assert math.isclose(r.clock_s, v[0] + v[1] * dt)


def test_the_pull_is_that_of_a_flattened_earth():
    """In the frame that does not turn, energy and the momentum about the axis stay."""
    s, fixed = np.array([[1.0e7, -1.5e7, 1.79e7, 1500.0, 2000.0, 900.0]]), np.zeros((1, 3))

    def kept(s):
        x, y, z, vx, vy, vz = s[0]
        ux, uy = vx - B.STATE_TURN * y, vy + B.STATE_TURN * x
        r = math.sqrt(x * x + y * y + z * z)
        flat = B.STATE_ZONAL * B.STATE_GRAVITY * B.STATE_RADIUS**2 / (2 * r**3) * (3 * z * z / r**2 - 1)
        return (ux * ux + uy * uy + vz * vz) / 2 - B.STATE_GRAVITY / r + flat, x * uy - y * ux

    before = kept(s)
    for _ in range(600):
        s = B.stepped(s, fixed, 10.0)
    assert all(math.isclose(a, b, rel_tol=1e-11) for a, b in zip(before, kept(s), strict=True))


def test_no_file_content(spark, tmp_path):
    (tmp_path / "empty.rnx").write_text("\n".join(header(3.04, "NAVIGATION DATA")))
    assert N.read_navigation(spark, str(tmp_path)).count() == 0 == N.read_navigation_states(spark, str(tmp_path)).count()
