import math
import random

from tecflow.functions import orientation as O


def test_published_example_and_way_back(spark):
    """A satellite on 6 April 2004: known in both frames; the nutation here keeps terms over 0.01 seconds of arc, some metres at ten thousand kilometres."""
    rng = random.Random(1)
    rows = [(0, 53101 + (7 * 3600 + 51 * 60 + 28.386009) / 86400, -0.140682, 0.333309, -0.4399619, -1033479.3830, 7901295.2754, 6380356.5958)]
    rows += [(i, rng.uniform(51600, 60000), rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), rng.uniform(-0.9, 0.9), *(rng.uniform(-3e7, 3e7) for _ in range(3))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "n int, mjd double, xp_s double, yp_s double, ut1_utc_s double, x double, y double, z double").cache()
    there = O.to_celestial(df).cache()
    first = there.where("n = 0").first()
    assert math.dist((first.xc, first.yc, first.zc), (5102509.6, 6123011.52, 6378136.3)) < 4
    for r in O.to_terrestrial(there, ("xc", "yc", "zc")).collect():
        assert math.dist((r.xt, r.yt, r.zt), (r.x, r.y, r.z)) < 1e-7  # some units in the last place of 3e7 m
        assert math.isclose(math.hypot(r.x, r.y, r.z), math.hypot(r.xc, r.yc, r.zc), rel_tol=1e-14)


def test_daily_parameters(spark, tmp_path):
    lines = ["header", " 57752.00  0.10 0.30 -0.40 extra", " 57753.00  0.20 0.20 -0.41", " 57754.00  0.30 0.10  0.58", " 57754.00  0.30 0.10  0.58", " 57756.00  0.50 0.10  0.57", " broken"]
    (tmp_path / "eop").write_text("\n".join(lines))
    daily = O.read_orientation(spark, str(tmp_path))
    assert daily.count() == 4
    at = [57752.0, 57752.5, 57753.75, 57754.0, 57754.5, 57756.0, 57751.9, None]
    got = [(r.mjd, r.xp_s, r.ut1_utc_s) for r in O.with_orientation(spark.createDataFrame([(i, t) for i, t in enumerate(at)], "n int, mjd double"), daily).orderBy("n").collect()]
    near = lambda a, b: all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[1:], b, strict=True))
    assert near(got[0], (0.10, -0.40)) and near(got[1], (0.15, -0.405))
    assert near(got[2], (0.275, -0.41 - 0.0075))  # the leap second at the end of this day is no jump of UT1
    assert near(got[3], (0.30, 0.58))
    assert all(near(got[i], (None, None)) for i in (4, 6, 7)) and near(got[5], (0.50, 0.57))
