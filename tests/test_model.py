"""The model correction against plain NumPy, step by step, on an inclined circular orbit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tecflow.functions import corrections as C, signal as X
from tecflow.plans import model as M

RADIUS, RATE, SPIN = 26_560_000.0, 2 * math.pi / 43_080, 7.2921151467e-5
STATION = np.array([-2_148_744.0, 4_426_641.0, 4_044_656.0])


def orbit(t):
    """Earth-fixed metres."""
    a, g, tilt = RATE * t + 1.2, SPIN * t, math.radians(55)
    x, y, z = np.cos(a), np.sin(a) * math.cos(tilt), np.sin(a) * math.sin(tilt)
    return RADIUS * np.array([np.cos(g) * x + np.sin(g) * y, np.cos(g) * y - np.sin(g) * x, z])


def clock(t):
    return 1e-4 + 1e-9 * t


@pytest.fixture(scope="module")
def states(spark):
    t = np.arange(-4, 30) * 900.0
    orbits = spark.createDataFrame([("2024-03-24", "G01", float(s), *(float(v) / 1000 for v in orbit(s))) for s in t], "date string, sat string, t double, x_km double, y_km double, z_km double")
    clocks = spark.createDataFrame([("2024-03-24", "G01", float(s), float(clock(s))) for s in np.arange(-10, 900) * 30.0], "date string, sat string, t double, bias_s double")
    rows = [("ABCD", "2024-03-24", "G01", 30.0 * k, None if k % 7 == 0 else float(np.linalg.norm(orbit(30.0 * k) - STATION)), 60393 + 30.0 * k / 86400) for k in range(600)]
    rows += [("ABCD", "2024-03-24", "G02", 30.0, 2e7, 60393.0), ("NONE", "2024-03-24", "G01", 60.0, 2e7, 60393.0)]
    obs = spark.createDataFrame(rows, "station string, date string, sat string, t double, c1 double, mjd double")
    stations = spark.createDataFrame([("ABCD", *map(float, STATION))], "station string, x double, y double, z double")
    return M.satellite_states(obs, orbits, clocks, stations).cache()


def test_states_equal_plain_steps(states):
    got = {r.t: r for r in states.where("sat = 'G01' and station = 'ABCD'").collect()}
    assert len(got) == 600
    for k in range(0, 600, 23):
        t = 30.0 * k
        code = 0.07 * X.LIGHT if k % 7 == 0 else np.linalg.norm(orbit(t) - STATION)
        sent = t - code / X.LIGHT
        at = orbit(sent - clock(sent))
        angle = np.linalg.norm(at - STATION) / X.LIGHT * SPIN
        turned = np.array([np.cos(angle) * at[0] + np.sin(angle) * at[1], np.cos(angle) * at[1] - np.sin(angle) * at[0], at[2]])
        r = got[t]
        assert abs(r.clock_s - clock(sent)) < 1e-13
        assert np.abs(np.array([r.sx, r.sy, r.sz]) - turned).max() < 30  # a cubic through points 15 minutes apart
        h = 0.5
        speed = (orbit(sent + h) - orbit(sent - h)) / (2 * h)
        assert np.abs(np.array([r.vx, r.vy, r.vz]) - speed).max() < 0.3
    assert states.where("sat = 'G02'").first().sx is None


def test_terms_and_sum(states):
    done = M.model_correction(M.model_terms(states.where("station = 'ABCD'")))
    rows = done.orderBy("t").collect()
    assert len(rows) == 600 and all(r.sat == "G01" for r in rows)
    for r in rows[::37]:
        s, v = np.array([r.sx, r.sy, r.sz]), np.array([r.vx, r.vy, r.vz])
        assert abs(r.range_m - np.linalg.norm(s - STATION)) < 1e-6
        assert abs(r.clock_m + r.clock_s * X.LIGHT) < 1e-9 and abs(r.relativity_m - 2 * s @ v / X.LIGHT) < 1e-9
        a, b, c = np.linalg.norm(s), np.linalg.norm(STATION), r.range_m
        assert abs(r.bending_m - 2 * 3.986004418e14 / X.LIGHT**2 * math.log((a + b + c) / (a + b - c))) < 1e-9
        assert abs(r.tide_m) < 0.5 and (r.elevation > 0) == (r.troposphere_m > 0)
        if r.elevation > 0.2:
            assert 2.0 < r.troposphere_m * math.sin(r.elevation) < 2.5
        total = r.range_m + r.clock_m + r.relativity_m + r.troposphere_m + r.bending_m + r.tide_m
        assert abs(r.model1_m - total - r.windup / (2 * math.pi) * X.LIGHT / X.GPS[0]) < 1e-6
        assert abs(r.model2_m - total - r.windup / (2 * math.pi) * X.LIGHT / X.GPS[1]) < 1e-6
    turns = np.diff([r.windup for r in rows])
    assert np.abs(turns).max() < math.pi


def test_tide_equals_plain_sum(spark):
    lat = math.asin(STATION[2] / np.linalg.norm(STATION))
    sun, moon = np.array([1.2e11, 8e10, 3e10]), np.array([3.1e8, -2.0e8, 1.1e8])
    unit = lambda v: v / np.linalg.norm(v)
    r, want = unit(STATION), np.zeros(3)
    turn = 3 * math.sin(lat) ** 2 - 1
    h, l = 0.6078 - 0.0006 * turn, 0.0847 + 0.0002 * turn
    for body, mass in ((sun, 332946.0), (moon, 0.01230002)):
        d, c = np.linalg.norm(body), unit(body) @ r
        side = unit(body) - c * r
        want += mass * 6378137.0**4 / d**3 * (h * r * (3 * c * c - 1) / 2 + 3 * l * c * side)
        if mass < 1:
            want += mass * 6378137.0**5 / d**4 * (0.292 * r * (2.5 * c**3 - 1.5 * c) + 0.015 * (7.5 * c * c - 1.5) * side)
    lits = [tuple(F.lit(float(x)) for x in v) for v in (STATION, sun, moon)]
    got = spark.range(1).select(*C.body_tide(lits[0], F.lit(lat), lits[1], lits[2])).first()
    assert np.abs(np.array(got) - want).max() < 1e-12


def test_antenna_offsets(spark, states):
    terms = M.model_terms(states.where("station = 'ABCD'"))
    sats = spark.createDataFrame([("G01", 1, 0.0, 0.0, 1.5), ("G01", 2, 0.0, 0.0, 1.5)], "sat string, band int, x double, y double, z double")
    receivers = spark.createDataFrame([("ABCD", 1, 0.0, 0.0, 0.1)], "station string, band int, north double, east double, up double")
    for r in M.antenna_terms(terms, sats, receivers).limit(50).collect():
        s = np.array([r.sx, r.sy, r.sz])
        sight = (STATION - s) / np.linalg.norm(STATION - s)
        lifted = -1.5 * (-s / np.linalg.norm(s)) @ sight
        assert abs(r.antenna2_m - lifted) < 1e-9 and abs(r.antenna1_m - lifted + 0.1 * math.sin(r.elevation)) < 1e-9


def test_phase_index_end_to_end(spark, states):
    """Phases made of the model and a swing in the pass band: states, terms, correction, removal and index together give the swing's own index."""
    from tecflow.plans import indices as I

    model = M.model_correction(M.model_terms(states.where("station = 'ABCD'"))).select("station", F.lit("2024-03-24").alias("date"), "sat", (F.col("t") / 30).cast("long").alias("epoch"), "t", "model1_m").cache()
    swing = 0.05 * F.sin(2 * math.pi * F.col("t") / 150)
    observed = model.select("station", "date", "sat", "epoch", (F.col("model1_m") + swing).alias("phase"))
    wanted = model.select("station", "date", "sat", "epoch", swing.alias("phase"))
    corrected = I.model_removed(observed, model, ["station", "date", "sat", "epoch"], "phase", "model1_m")
    got, want = ({r.epoch: r.sigma_phi for r in I.phase_index(df, "phase").collect()} for df in (corrected, wanted))
    assert len(got) == 600 and sum(v is not None for v in got.values()) > 500
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-6) for k in got)
    assert 0.02 < np.median([v for v in got.values() if v is not None]) < 0.05
