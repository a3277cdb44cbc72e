import math

import pytest
from pyspark.sql import functions as F

from tecflow.functions import corrections as C, geometry as G
from tecflow.operators import aggregates as A


def value(spark, *columns):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(r)


def vector(*xyz):
    return tuple(F.lit(float(v)) for v in xyz)


def test_sun_and_moon(spark):
    # 2024-03-20 03:06 UTC is an equinox: the Sun stands over the equator, at noon near longitude 180 - 46.5.
    mjd = F.lit(60389 + 3.1 / 24)
    x, y, z, *m = value(spark, *C.sun(mjd), *C.moon(mjd))
    d = math.sqrt(x * x + y * y + z * z)
    assert abs(d / C.UNIT - 0.996) < 0.002 and abs(math.degrees(math.asin(z / d))) < 0.1
    assert abs(math.degrees(math.atan2(y, x)) - (180 - 46.5 + 1.9)) < 1
    assert 356e6 < math.sqrt(sum(v * v for v in m)) < 407e6


def test_sizes_of_corrections(spark):
    site, sat = vector(6378137, 0, 0), vector(26560e3, 0, 0)
    bend, rel = value(spark, C.bending(sat, site), C.relativistic_clock(sat, vector(100, 0, 0)))
    assert 0.005 < bend < 0.025 and rel == pytest.approx(-2 * 26560e3 * 100 / C.LIGHT**2)
    tide = value(spark, *C.solid_tide(site, vector(3.844e8, 0, 0), C.MOON_GM))
    assert 0.15 < tide[0] < 0.25 and abs(tide[1]) < 1e-12
    dry, wet, hd, hw = value(spark, C.zenith_dry(F.lit(1013.25), F.lit(0.8), F.lit(0.0)), C.zenith_wet(F.lit(290.0), F.lit(12.0)), *C.hopfield(F.lit(1013.25), F.lit(290.0), F.lit(12.0)))
    assert 2.29 < dry < 2.32 and 0.1 < wet < 0.14 and abs(hd - dry) < 0.03 and abs(hw - wet) < 0.03
    zenith, low = value(spark, C.slant_delay(F.lit(math.pi / 2), F.lit(2.3), F.lit(0.1)), C.slant_delay(F.lit(math.radians(10)), F.lit(2.3), F.lit(0.1)))
    assert zenith == pytest.approx(2.4) and 5 < low / zenith < 6


def test_antennas_and_windup(spark):
    sat, site, to_sun = vector(26560e3, 0, 0), vector(6378137, 0, 0), vector(0, 1.5e11, 0)
    # An offset of a metre towards the Earth shortens the path to the site below by a metre.
    off, up = value(spark, C.antenna_offset(sat, to_sun, site, vector(0, 0, 1)), C.receiver_offset(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(math.pi / 2), F.lit(0.0)))
    assert off == pytest.approx(-1) and up == pytest.approx(0.1)
    turn = [value(spark, C.windup_angle(sat, vector(0, 1.5e11 * math.cos(a), 1.5e11 * math.sin(a)), site, vector(0, 0, 1), vector(0, -1, 0)))[0] for a in (0.0, 0.5)]
    assert abs(abs(turn[1] - turn[0]) - 0.5) < 1e-6


def test_dilution_equals_the_inverse(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for k in range(3):
        el, az = rng.uniform(0.2, 1.5, 6 - k), rng.uniform(0, 6.28, 6 - k)
        rows += [(k, float(e), float(a)) for e, a in zip(el, az, strict=True)]
    rows.append((9, 1.0, 1.0))
    df = spark.createDataFrame(rows, "k int, el double, az double")
    got = {r.k: r for r in A.dilution(df, ["k"], F.cos("el") * F.sin("az"), F.cos("el") * F.cos("az"), F.sin("el")).collect()}
    for k in range(3):
        h = np.array([[math.cos(e) * math.sin(a), math.cos(e) * math.cos(a), math.sin(e), 1] for g, e, a in rows if g == k])
        q = np.linalg.inv(h.T @ h)
        assert got[k].pdop == pytest.approx(math.sqrt(np.trace(q[:3, :3]))) and got[k].tdop == pytest.approx(math.sqrt(q[3, 3])) and got[k].gdop == pytest.approx(math.sqrt(np.trace(q)))
    assert got[9].gdop is None


def test_geodetic_round_trip(spark):
    x, y, z = G.earth_fixed(F.lit(0.7), F.lit(-2.0), F.lit(350.0))
    lat, lon, h = value(spark, *G.geodetic(x, y, z))
    assert lat == pytest.approx(0.7, abs=1e-10) and lon == pytest.approx(-2.0) and h == pytest.approx(350, abs=1e-4)
