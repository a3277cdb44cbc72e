"""Satellite states at the time of transmission and the model correction of phases, as joins and wide expressions.

Times t are seconds on one scale for observations, orbits and clocks; keys name
what a satellite's day is, so that no partition holds more than that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import corrections as C, geometry as G, signal as X, troposphere as Z
from ..operators import grouped as P, joins as J, series as S

Names = Sequence[str]
KEYS = ("date", "sat")
#: Travel time (s) where no code is measured, Terrestrial less GPS time (s).
TRAVEL, TERRESTRIAL = 0.070, 51.184


def vector(prefix: str) -> C.Vector:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def held(df: DataFrame, **vectors: C.Vector) -> DataFrame:
    """df with vectors as columns _name_x, _name_y and _name_z, so that what is made of them doesn't repeat them."""
    return df.withColumns({f"_{name}_{c}": v for name, parts in vectors.items() for c, v in zip("xyz", parts, strict=True)})


def satellite_states(obs: DataFrame, orbits: DataFrame, clocks: DataFrame, stations: DataFrame, keys: Names = KEYS, code: str = "c1", step: float = 900.0) -> DataFrame:
    """obs (station, keys, t, code) with clock_s, the satellite's place sx, sy, sz (m) and speed vx, vy, vz (m/s) at transmission, in the frame at reception, and the station's rx, ry, rz.

    orbits: keys, t, x_km, y_km, z_km; clocks: keys, t, bias_s; stations: station,
    x, y, z (m). Rows whose satellite has no orbit or clock around their time have
    null states. A clock is looked up at the approximate time of transmission and,
    before the first one, at that of reception. Satellites are looked up within their
    keys: with a day among them, give each day's orbits and clocks those of its
    neighbours' edges too, or the day's first and last rows stay null. However many
    stations see a satellite, its rows need no common task.
    """
    travel = F.when(F.col(code) > 0, F.col(code) / X.LIGHT).otherwise(TRAVEL)
    rows = obs.withColumn("_sent", F.col("t") - travel)
    known = clocks.where("bias_s is not null").select(*keys, F.col("t").alias("_sent"), F.col("bias_s").alias("_b"))
    rows = J.bracketed(rows, known, keys, "_sent", "_b", step).withColumnRenamed("_b", "_first")
    rows = J.bracketed(rows, known.withColumnRenamed("_sent", "t"), keys, "t", "_b", step)
    rows = rows.withColumn("clock_s", F.coalesce("_first", "_b")).withColumn("_sent", F.col("_sent") - F.col("clock_s")).drop("_first", "_b")
    anchors = orbits.select(*keys, F.col("t").alias("_sent"), *[(F.col(f"{c}_km") * 1000).alias(f"_{c}") for c in "xyz"])
    rows = P.splined(rows, anchors, keys, "_sent", ["_x", "_y", "_z"], step)
    rows = rows.join(stations.select("station", *[F.col(c).alias(f"r{c}") for c in "xyz"]), "station", "left")
    place, speed = vector("_"), tuple(F.col(f"_{c}_rate") for c in "xyz")
    late = C.length(C.plus(place, vector("r"), -1.0)) / X.LIGHT
    for names, v in (("s", place), ("v", speed)):
        rows = rows.withColumns(dict(zip([f"_{names}{c}" for c in "xyz"], G.earth_rotated(*v, late), strict=True)))
    return rows.drop("_sent", *[f"_{c}{end}" for c in "xyz" for end in ("", "_rate")]).withColumnsRenamed({f"_{n}{c}": f"{n}{c}" for n in "sv" for c in "xyz"})


def shifted(north: Column, east: Column, up: Column) -> Column:
    """What an offset of the receiver's antenna adds to the range: it shortens where it points to the satellite."""
    return -C.receiver_offset(north, east, up, F.col("elevation"), F.col("azimuth"))


def model_terms(states: DataFrame, pressure_hpa: float = 1013.25, order: Names = ("t",), arc: Names = ("station", "sat")) -> DataFrame:
    """states (of satellite_states, with mjd, the modified Julian date of t) with elevation, azimuth and the model's terms in metres; rows without a state go.

    range_m, clock_m, relativity_m, troposphere_m (slant, hydrostatic), bending_m,
    tide_m, and windup, the wind-up angle in radians, which runs on along arc. Columns
    dry_a and dry_c (of troposphere.site_days) give the mapping of the dry delay,
    pressure_hpa the pressure, where they are there and not null.
    """
    rows = states.where("sx is not null and clock_s is not null")
    lat, lon, height = G.geodetic(*vector("r"))
    rows = rows.withColumns({"_lat": lat, "_lon": lon, "_height": height, "_tt": F.col("mjd") + TERRESTRIAL / 86400})
    for name, body in (("sun", C.sun), ("moon", C.moon)):
        rows = rows.withColumns(dict(zip([f"_{name}{c}" for c in "xyz"], body(F.col("_tt")), strict=True)))
    s, v, r, sun, moon = vector("s"), vector("v"), vector("r"), vector("_sun"), vector("_moon")
    at = lambda name: vector(f"_{name}_")
    north = (-F.sin("_lat") * F.cos("_lon"), -F.sin("_lat") * F.sin("_lon"), F.cos("_lat"))
    west = (F.sin("_lon"), -F.cos("_lon"), F.lit(0.0))
    rows = rows.withColumns({"range_m": C.length(C.plus(s, r, -1.0)), "_sun_far": C.length(sun), "_moon_far": C.length(moon)})
    local = G.local(F.col("_lat"), F.col("_lon"), *C.plus(s, r, -1.0))
    rows = held(rows, sight=C.scaled(C.plus(r, s, -1.0), 1 / F.col("range_m")), down=C.unit(C.scaled(s, -1.0)), sun=C.unit(C.plus(sun, s, -1.0)), up=C.unit(r), solar=C.scaled(sun, 1 / F.col("_sun_far")), lunar=C.scaled(moon, 1 / F.col("_moon_far")), north=north, west=west, local=local)
    el, az = G.elevation_azimuth(*at("local"))
    rows = held(rows.withColumns({"elevation": el, "azimuth": az}), across=C.unit(C.cross(at("down"), at("sun"))))
    rows = held(rows, ahead=C.cross(at("across"), at("down")))
    rows = held(rows, sent=C.dipole(at("ahead"), at("across"), at("sight"), -1.0), received=C.dipole(at("north"), at("west"), at("sight"), 1.0), tide=C.tide_of_units(at("up"), F.col("_lat"), (at("solar"), F.col("_sun_far")), (at("lunar"), F.col("_moon_far"))))
    pressure = F.coalesce(F.col("pressure_hpa"), F.lit(pressure_hpa)) if "pressure_hpa" in states.columns else F.lit(pressure_hpa)
    rows = rows.withColumn("_dry", C.zenith_dry(pressure, F.col("_lat"), F.col("_height")))
    slant = C.slant_delay(F.col("elevation"), F.col("_dry"), F.lit(0.0))
    if "dry_a" in states.columns:
        slant = F.coalesce(Z.dry_factor(F.col("elevation"), F.col("dry_a"), F.col("dry_c"), F.col("_height")) * F.col("_dry"), slant)
    terms = {
        "clock_m": -F.col("clock_s") * X.LIGHT,
        "relativity_m": -X.LIGHT * C.relativistic_clock(s, v),
        "troposphere_m": F.when(F.col("elevation") > 0, slant).otherwise(0.0),
        "bending_m": C.bending(s, r),
        "tide_m": C.dot(at("tide"), at("sight")),
        "_angle": C.dipole_angle(at("sent"), at("received"), at("sight")),
    }
    kept = [*states.columns, "elevation", "azimuth", "range_m", *terms]
    rows = rows.withColumns(terms).select(*kept, *[F.col(f"_sun{c}").alias(f"sun_{c}") for c in "xyz"])
    return S.unwrapped(rows, arc, order, "_angle", "windup").drop("_angle")


PATTERN = ("grid_mm", "zenith_from", "zenith_step", "azimuth_step")


def antenna_terms(terms: DataFrame, satellites: DataFrame, receivers: DataFrame) -> DataFrame:
    """terms with antenna1_m and antenna2_m, what both antennas add on each carrier; where an offset or a pattern isn't known, nothing.

    satellites: sat, band (1 or 2), x, y, z (m, satellite axes); receivers: station,
    band, north, east, up (m, antenna offset and the header's height, east and
    north together). Both may have the columns PATTERN of read_patterns: a satellite's is
    taken by the angle off its nadir, without azimuth; a receiver's by zenith and azimuth.
    """
    out = terms
    for band in (1, 2):
        sides = []
        for table, key, names in ((satellites, "sat", ("x", "y", "z")), (receivers, "station", ("north", "east", "up"))):
            more = [c for c in PATTERN if c in table.columns]
            sides.append((table.where(F.col("band") == band).select(key, *[F.col(c).alias(f"_{key}_{c}") for c in (*names, *more)]), key, bool(more)))
        for side, key, _ in sides:
            out = out.join(side, key, "left")
        sat = C.antenna_offset(vector("s"), vector("sun_"), vector("r"), vector("_sat_"))
        total = F.coalesce(sat, F.lit(0.0)) + F.coalesce(shifted(*[F.col(f"_station_{c}") for c in ("north", "east", "up")]), F.lit(0.0))
        nadir = F.degrees(F.acos(F.least(C.dot(C.unit(vector("s")), C.unit(C.plus(vector("s"), vector("r"), -1.0))), F.lit(1.0))))
        for (_, key, known), zenith, azimuth in zip(sides, (nadir, 90 - F.degrees("elevation")), (F.lit(0.0), F.degrees("azimuth")), strict=True):
            if known:
                total = total + F.coalesce(C.pattern_value(*[F.col(f"_{key}_{c}") for c in PATTERN], zenith, azimuth) / 1000, F.lit(0.0))
        out = out.withColumn(f"antenna{band}_m", total).select(*terms.columns, *[f"antenna{k}_m" for k in range(1, band + 1)])
    return out


def model_correction(terms: DataFrame, carriers: tuple[float, float] = X.GPS) -> DataFrame:
    """terms with model1_m and model2_m: what a phase in metres has in it besides the ionosphere and its ambiguity."""
    common = sum((F.col(c) for c in ("clock_m", "relativity_m", "troposphere_m", "bending_m", "tide_m")), F.col("range_m"))
    wave = lambda f: F.col("windup") / (2 * math.pi) * (X.LIGHT / f)
    out = terms
    for band, f in zip((1, 2), carriers, strict=True):
        antenna = F.col(f"antenna{band}_m") if f"antenna{band}_m" in terms.columns else F.lit(0.0)
        out = out.withColumn(f"model{band}_m", common + antenna + wave(f))
    return out
