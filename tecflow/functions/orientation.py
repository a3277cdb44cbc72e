"""Between the celestial and the terrestrial frame: precession, nutation, Earth's rotation and the pole, as column expressions.

Angles are worked out once for a row, in steps; places are turned about one axis
after the other, each turn a projection of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import geometry as G, names as N

SECOND = math.pi / 648000  # of arc
#: Arguments of the Moon, the Sun, the Moon's latitude, their distance and the node, in seconds of arc by powers of centuries; turns of 1296000 are in the second.
ARGUMENTS = (
    (485866.733, 1717915922.633, 31.310, 0.064),
    (1287099.804, 129596581.224, -0.577, -0.012),
    (335778.877, 1739527263.137, -13.257, 0.011),
    (1072261.307, 1602961601.328, -6.891, 0.019),
    (450160.280, -6962890.539, 7.455, 0.008),
)
#: Largest terms of nutation: how often each argument counts, in longitude and its change in a century, in obliquity and its change (0.0001 seconds of arc).
NUTATION = (
    (0, 0, 0, 0, 1, -171996.0, -174.2, 92025.0, 8.9),
    (0, 0, 2, -2, 2, -13187.0, -1.6, 5736.0, -3.1),
    (0, 0, 2, 0, 2, -2274.0, -0.2, 977.0, -0.5),
    (0, 0, 0, 0, 2, 2062.0, 0.2, -895.0, 0.5),
    (0, 1, 0, 0, 0, 1426.0, -3.4, 54.0, -0.1),
    (1, 0, 0, 0, 0, 712.0, 0.1, -7.0, 0.0),
    (0, 1, 2, -2, 2, -517.0, 1.2, 224.0, -0.6),
    (0, 0, 2, 0, 1, -386.0, -0.4, 200.0, 0.0),
    (1, 0, 2, 0, 2, -301.0, 0.0, 129.0, -0.1),
    (0, -1, 2, -2, 2, 217.0, -0.5, -95.0, 0.3),
    (1, 0, 0, -2, 0, -158.0, 0.0, -1.0, 0.0),
    (0, 0, 2, -2, 1, 129.0, 0.1, -70.0, 0.0),
    (-1, 0, 2, 0, 2, 123.0, 0.0, -53.0, 0.0),
)
#: Angles of precession and the obliquity, in seconds of arc by powers of centuries; sidereal time in seconds likewise.
ZETA, Z, THETA, OBLIQUITY = (0.0, 2306.2181, 0.30188, 0.017998), (0.0, 2306.2181, 1.09468, 0.018203), (0.0, 2004.3109, -0.42665, -0.041833), (84381.448, -46.8150, -0.00059, 0.001813)
SIDEREAL = (67310.54841, 876600 * 3600 + 8640184.812866, 0.093104, -6.2e-6)
#: Terrestrial time less atomic time (s).
TERRESTRIAL = 32.184


def polynomial(c: Sequence[float], t: Column) -> Column:
    return c[0] + t * (c[1] + t * (c[2] + t * c[3]))


def read_orientation(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(mjd, xp_s, yp_s, ut1_utc_s) from lines that begin with a blank: day, pole in seconds of arc, UT1 less UTC in seconds; of repeated days one stays."""
    part = F.split(F.trim("value"), " +")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    rows = spark.read.text(paths).where(F.col("value").startswith(" ")).select(*[number(k).alias(n) for k, n in enumerate(("mjd", "xp_s", "yp_s", "ut1_utc_s"))])
    return rows.dropna().dropDuplicates(["mjd"])


def with_orientation(rows: DataFrame, daily: DataFrame, mjd: str = "mjd") -> DataFrame:
    """rows (mjd: UTC) with xp_s, yp_s and ut1_utc_s between the days around them; null outside, and where a day is missing.

    A leap second at a day's end is no jump of UT1. A row meets its day by equality.
    """
    w = Window.orderBy("_d")  # one row a day
    day = daily.select(F.floor("mjd").cast("long").alias("_d"), "xp_s", "yp_s", (F.col("ut1_utc_s") - N.leap_seconds(F.floor("mjd"))).alias("_u")).dropDuplicates(["_d"])
    follows = F.lead("_d").over(w) == F.col("_d") + 1
    day = day.select("_d", *[F.col(c).alias(f"_0{c}") for c in ("xp_s", "yp_s", "_u")], *[F.when(follows, F.lead(c).over(w)).alias(f"_1{c}") for c in ("xp_s", "yp_s", "_u")])
    at = rows.withColumn("_on", F.floor(mjd).cast("long"))
    u = F.col(mjd) - F.col("_on")
    line = lambda c: F.when(u == 0, F.col(f"_0{c}")).otherwise(F.col(f"_0{c}") + (F.col(f"_1{c}") - F.col(f"_0{c}")) * u)
    met = at.join(day, at["_on"] == day["_d"], "left")
    return met.select(*[at[c] for c in rows.columns], line("xp_s").alias("xp_s"), line("yp_s").alias("yp_s"), (line("_u") + N.leap_seconds(F.col("_on"))).alias("ut1_utc_s"))


def with_angles(rows: DataFrame, mjd: str = "mjd") -> DataFrame:
    """rows of with_orientation with the angles of all turns, in order: about axes 3, 2, 3, 1, 3, 1, 3, 2 and 1, as _t0 to _t8."""
    utc, col = F.col(mjd), F.col
    tt = utc + (N.leap_seconds(F.floor(utc)) + TERRESTRIAL) / 86400
    df = rows.withColumns({"_c": (tt - 51544.5) / 36525, "_v": (utc + col("ut1_utc_s") / 86400 - 51544.5) / 36525})
    df = df.withColumns({f"_a{k}": polynomial(a, col("_c")) * SECOND for k, a in enumerate(ARGUMENTS)}).withColumn("_e", polynomial(OBLIQUITY, col("_c")) * SECOND)
    angle = lambda t: sum((col(f"_a{k}") * n for k, n in enumerate(t[:5]) if n), F.lit(0.0))
    longitude = sum((F.sin(angle(t)) * (t[5] + col("_c") * t[6]) for t in NUTATION), F.lit(0.0))
    oblique = sum((F.cos(angle(t)) * (t[7] + col("_c") * t[8]) for t in NUTATION), F.lit(0.0))
    df = df.withColumns({"_dl": longitude * (SECOND * 1e-4), "_de": oblique * (SECOND * 1e-4)})
    gmst = F.pmod(polynomial(SIDEREAL, col("_v")), F.lit(86400.0)) * (math.pi / 43200)
    spin = gmst + col("_dl") * F.cos("_e") + (0.00264 * F.sin("_a4") + 0.000063 * F.sin(2 * col("_a4"))) * SECOND
    turns = [-polynomial(ZETA, col("_c")) * SECOND, polynomial(THETA, col("_c")) * SECOND, -polynomial(Z, col("_c")) * SECOND, col("_e"), -col("_dl"), -col("_e") - col("_de"), spin, -col("xp_s") * SECOND, -col("yp_s") * SECOND]
    return df.withColumns({f"_t{k}": t for k, t in enumerate(turns)}).drop("_c", "_v", "_e", "_dl", "_de", *[f"_a{k}" for k in range(5)])


AXES = (3, 2, 3, 1, 3, 1, 3, 2, 1)


def turned(rows: DataFrame, place: Sequence[str], out: Sequence[str], back: bool = False) -> DataFrame:
    """rows of with_angles with place turned from the celestial to the terrestrial frame, or back, as out."""
    df = rows.withColumns({f"_p{i}": F.col(c) for i, c in enumerate(place)})
    order = range(len(AXES))
    for k in reversed(order) if back else order:
        angle = -F.col(f"_t{k}") if back else F.col(f"_t{k}")
        df = df.withColumns({f"_p{i}": c for i, c in enumerate(G.rotated(*[F.col(f"_p{i}") for i in range(3)], AXES[k], angle))})
    return df.withColumns({name: F.col(f"_p{i}") for i, name in enumerate(out)}).drop(*[f"_p{i}" for i in range(3)])


def to_terrestrial(rows: DataFrame, place: Sequence[str] = ("x", "y", "z"), out: Sequence[str] = ("xt", "yt", "zt"), mjd: str = "mjd") -> DataFrame:
    """rows (mjd: UTC, xp_s, yp_s, ut1_utc_s) with a celestial place as a terrestrial one."""
    return turned(with_angles(rows, mjd), place, out).drop(*[f"_t{k}" for k in range(9)])


def to_celestial(rows: DataFrame, place: Sequence[str] = ("x", "y", "z"), out: Sequence[str] = ("xc", "yc", "zc"), mjd: str = "mjd") -> DataFrame:
    """rows (mjd: UTC, xp_s, yp_s, ut1_utc_s) with a terrestrial place as a celestial one."""
    return turned(with_angles(rows, mjd), place, out, back=True).drop(*[f"_t{k}" for k in range(9)])
