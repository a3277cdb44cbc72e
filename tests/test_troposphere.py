import math
import random

import pytest
from pyspark.sql import functions as F

from tecflow.functions import corrections as C, geometry as G, troposphere as Z
from tecflow.plans import model as M


def summed(a, b, lat, lon, degree=9):
    """The sum by the usual recursion over degree and order."""
    x, y, z = math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)
    v, w = {(0, 0): 1.0}, {(0, 0): 0.0}
    for n in range(1, degree + 1):
        for m in range(n):
            for s in (v, w):
                s[n, m] = ((2 * n - 1) * z * s[n - 1, m] - (n + m - 1) * s.get((n - 2, m), 0.0)) / (n - m)
        v[n, n] = (2 * n - 1) * (x * v[n - 1, n - 1] - y * w[n - 1, n - 1])
        w[n, n] = (2 * n - 1) * (x * w[n - 1, n - 1] + y * v[n - 1, n - 1])
    return sum(a[p] * v[p] + b[p] * w[p] for p in v)


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    rng, at = random.Random(7), tmp_path_factory.mktemp("models")
    known, text = {}, ["# name degree order a b a b"]
    for name in ("dry", "wet", "pressure", "temperature"):
        for n in range(10):
            for m in range(n + 1):
                scale = 1 / math.prod(range(n - m + 1, n + m + 1))
                known[name, n, m] = values = [rng.uniform(-3, 3) * scale + (k == 0 == n) * {"dry": 125, "wet": 56, "pressure": 1010, "temperature": 15}[name] for k in range(4)]
                text.append(f"{name} {n} {m} " + " ".join(map(repr, values)) + ("  # first" if n == 0 else ""))
    (at / "models.txt").write_text("\n".join(text))
    return str(at / "models.txt"), known


def test_models_equal_the_recursion(spark, lines):
    path, known = lines
    models = Z.read_seasonal(spark, path)
    assert set(models) == {"dry", "wet", "pressure", "temperature"}
    rng = random.Random(2)
    places = [(rng.uniform(-1.57, 1.57), rng.uniform(-3.1, 6.2), rng.uniform(50000, 62000), rng.uniform(0, 4000)) for _ in range(40)] + [(math.pi / 2, 0.0, 6e4, 0.0), (-math.pi / 2, 1.0, 6e4, 10.0), (0.0, math.pi, 6e4, 0.0)]
    days = spark.createDataFrame([("S", "d", mjd, lat, lon, h) for lat, lon, mjd, h in places], "station string, date string, mjd double, lat double, lon double, height_m double")
    got = Z.site_days(days, models).withColumns({"df": Z.dry_factor(F.lit(0.3), F.col("dry_a"), F.col("dry_c"), F.col("height_m")), "wf": Z.wet_factor(F.lit(0.3), F.col("wet_a"))}).collect()
    for r in got:
        turn = math.cos((r.mjd - 44239.0 + 1.0 - 28.0) / 365.25 * 2 * math.pi)
        part = lambda name, k: {(n, m): known[name, n, m][k] for n in range(10) for m in range(n + 1)}
        value = {name: summed(part(name, 0), part(name, 1), r.lat, r.lon) + turn * summed(part(name, 2), part(name, 3), r.lat, r.lon) for name in models}
        assert math.isclose(r.dry_a, value["dry"] * 1e-5, rel_tol=1e-9) and math.isclose(r.wet_a, value["wet"] * 1e-5, rel_tol=1e-9)
        assert math.isclose(r.pressure_hpa, value["pressure"] * (1 - 2.26e-5 * r.height_m) ** 5.225, rel_tol=1e-9)
        assert math.isclose(r.temperature_c, value["temperature"] - 6.5e-3 * r.height_m, rel_tol=1e-9)
        c = 0.062 + ((math.cos((r.mjd - 44266) / 365.25 * 2 * math.pi + (math.pi if r.lat < 0 else 0)) + 1) * (0.007 if r.lat < 0 else 0.005) / 2 + (0.002 if r.lat < 0 else 0.001)) * (1 - math.cos(r.lat))
        s = math.sin(0.3)
        fraction = lambda a, b, c: (1 + a / (1 + b / (1 + c))) / (s + a / (s + b / (s + c)))
        assert math.isclose(r.df, fraction(r.dry_a, 0.0029, c) + (1 / s - fraction(2.53e-5, 5.49e-3, 1.14e-3)) * r.height_m / 1000, rel_tol=1e-9)
        assert math.isclose(r.wf, fraction(r.wet_a, 0.00146, 0.04391), rel_tol=1e-9)


def test_the_model_correction_takes_mapping_and_pressure(spark):
    """Two rows that differ only in what is known of the troposphere."""
    here = (-2148744.0, 4426641.0, 4044656.0)
    rows = [("ABCD", sat, 0.0, 60000.0, 1e-4, *(x * 4 + 1000 for x in here), 0.0, 3000.0, 0.0, *here, a, c, p) for sat, a, c, p in (("G01", None, None, None), ("G02", 0.00125, 0.063, 900.0))]
    states = spark.createDataFrame(rows, "station string, sat string, t double, mjd double, clock_s double, sx double, sy double, sz double, vx double, vy double, vz double, rx double, ry double, rz double, dry_a double, dry_c double, pressure_hpa double").cache()
    got = {r.sat: r for r in M.model_terms(states).select("sat", "elevation", "troposphere_m").collect()}
    lat, _, h = states.select(*G.geodetic(F.col("rx"), F.col("ry"), F.col("rz"))).first()
    el = F.lit(got["G01"].elevation)
    want = spark.range(1).select(C.slant_delay(el, C.zenith_dry(F.lit(1013.25), F.lit(lat), F.lit(h)), F.lit(0.0)), C.zenith_dry(F.lit(900.0), F.lit(lat), F.lit(h)) * Z.dry_factor(el, F.lit(0.00125), F.lit(0.063), F.lit(h))).first()
    assert math.isclose(got["G01"].troposphere_m, want[0], rel_tol=1e-9) and math.isclose(got["G02"].troposphere_m, want[1], rel_tol=1e-9)


def test_grids(spark, tmp_path):
    for name, add in (("one.H00", 0.0), ("two.H06", 500.0)):
        nodes = [f"{lat} {lon} {lat * 2 + lon + add} {lat}" for lat in (90, 60, 30, 0, -30, -60, -90) for lon in range(0, 360, 60) if (lat, lon) != (30, 120)]
        (tmp_path / name).write_text("\n".join(["! a comment", *nodes, "broken line"]))
    grid = Z.read_grid(spark, str(tmp_path), ["ah", "aw"])
    assert grid.count() == 82
    at = [("one.H00", 45.0, 30.0), ("two.H06", 45.0, 30.0), ("one.H00", 90.0, 0.0), ("one.H00", -90.0, 60.0), ("one.H00", 10.0, 350.0), ("one.H00", 10.0, -10.0), ("one.H00", 20.0, 100.0), ("one.H00", 60.0, 60.0), ("none", 1.0, 1.0), ("one.H00", None, 1.0)]
    rows = [(i, *x) for i, x in enumerate(at)]
    got = {r.n: (r.ah, r.aw) for r in Z.gridded(spark.createDataFrame(rows, "n int, epoch string, lat double, lon double"), grid, ["ah", "aw"], 90.0, 30.0, 0.0, 60.0).collect()}
    assert got[0] == (pytest.approx(120.0), pytest.approx(45.0)) and got[1][0] == pytest.approx(620.0)
    assert got[2][0] == pytest.approx(180.0) and got[3][0] == pytest.approx(-120.0) and got[7][0] == pytest.approx(180.0)
    assert got[4] == got[5] and got[4][0] == pytest.approx(20 + 300 * (10 / 60))  # from 300 to the node at 0
    assert got[6] == (None, None) and got[8] == (None, None)
