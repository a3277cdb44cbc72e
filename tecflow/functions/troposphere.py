"""Mapping of zenith delays, pressure and temperature from seasonal spherical harmonics and from gridded files.

A surface is a sum over degree n and order m of a cos(m lon) + b sin(m lon), times
the m-th derivative of the n-th Legendre polynomial of sin(lat) and cos(lat)^m. For
each order the sum over degrees is one polynomial in sin(lat), whose coefficients
are worked out once, so that a column holds ten short polynomials and no recursion.
The coefficients are the caller's: tables of published models are files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .corrections import continued_fraction

#: Day from which seasons are counted (modified Julian date), days of a year.
SEASON_START, YEAR = 44239.0 - 1 + 28, 365.25
#: Fixed values of the global mapping: b of both factors, c of the wet one; for the dry one c, and what season and latitude add, north and south; height correction.
DRY_B, WET_B, WET_C, DRY_C = 0.0029, 0.00146, 0.04391, 0.062
NORTH, SOUTH = (0.005, 0.001), (0.007, 0.002)
HEIGHT = (2.53e-5, 5.49e-3, 1.14e-3)


@dataclass(frozen=True)
class Surface:
    """Coefficients of a surface by (degree, order): a and b."""

    a: dict[tuple[int, int], float]
    b: dict[tuple[int, int], float]

    def polynomials(self, which: dict[tuple[int, int], float]) -> dict[int, np.ndarray]:
        """For each order the polynomial in sin(lat), lowest power first."""
        out: dict[int, np.ndarray] = {}
        for (n, m), value in which.items():
            if value:
                legendre = np.polynomial.legendre.leg2poly([0.0] * n + [value])
                part = np.polynomial.polynomial.polyder(legendre, m) if m else legendre
                out[m] = np.polynomial.polynomial.polyadd(out.get(m, np.zeros(1)), part)
        return out

    def at(self, lat: Column, lon: Column) -> Column:
        z, out = F.sin(lat), F.lit(0.0)
        for which, turn in ((self.a, F.cos), (self.b, F.sin)):
            for m, poly in sorted(self.polynomials(which).items()):
                if turn is F.sin and not m:
                    continue
                value = F.lit(float(poly[-1]))
                for c in poly[-2::-1]:
                    value = value * z + float(c)
                out = out + value * (F.pow(F.cos(lat), m) * turn(m * lon) if m else F.lit(1.0))
        return out


@dataclass(frozen=True)
class Seasonal:
    """A surface that swings once a year: mean + amplitude cos(2 pi days / year)."""

    mean: Surface
    amplitude: Surface

    def at(self, lat: Column, lon: Column, mjd: Column) -> Column:
        return self.mean.at(lat, lon) + self.amplitude.at(lat, lon) * F.cos(season(mjd))


def season(mjd: Column) -> Column:
    return (mjd - SEASON_START) * (2 * math.pi / YEAR)


def read_seasonal(spark: SparkSession, paths: str | list[str]) -> dict[str, Seasonal]:
    """Models by name from lines of name, degree, order, and a and b of mean and amplitude; # begins a comment. A model has some hundred lines."""
    part = F.split(F.trim(F.regexp_replace("value", "#.*", "")), "[ ,\t]+")
    rows = spark.read.text(paths).select(part.alias("p")).where(F.size("p") == 7)
    found: dict[str, list[dict[tuple[int, int], float]]] = {}
    for r in rows.collect():
        name, n, m, *values = r["p"]
        kinds = found.setdefault(name, [{}, {}, {}, {}])
        for kind, value in zip(kinds, values, strict=True):
            kind[int(n), int(m)] = float(value)
    return {name: Seasonal(Surface(k[0], k[1]), Surface(k[2], k[3])) for name, k in found.items()}


def dry_c(lat: Column, mjd: Column) -> Column:
    """The third coefficient of the dry mapping, by season and latitude."""
    swing = lambda side, turn: (F.cos(season(mjd) + turn) + 1) * (side[0] / 2) + side[1]
    return DRY_C + F.when(lat < 0, swing(SOUTH, math.pi)).otherwise(swing(NORTH, 0.0)) * (1 - F.cos(lat))


def dry_factor(elevation: Column, a: Column, c: Column, height_m: Column) -> Column:
    """Slant over zenith of the dry delay, with the correction for height."""
    return continued_fraction(elevation, a, DRY_B, c) + (1 / F.sin(elevation) - continued_fraction(elevation, *HEIGHT)) * height_m / 1000


def wet_factor(elevation: Column, a: Column) -> Column:
    return continued_fraction(elevation, a, WET_B, WET_C)


def pressure_at(height_m: Column, sea_level_hpa: Column) -> Column:
    """Pressure at a height above the geoid."""
    return sea_level_hpa * F.pow(1 - 2.26e-5 * height_m, 5.225)


def temperature_at(height_m: Column, sea_level_c: Column) -> Column:
    return sea_level_c - 6.5e-3 * height_m


def site_days(days: DataFrame, models: dict[str, Seasonal], geoid: Surface | None = None) -> DataFrame:
    """days (station, date, mjd, lat, lon in radians, height_m) with what the models give: dry_a and wet_a (models dry and wet, in 1e-5), dry_c, pressure_hpa and temperature_c (models pressure and temperature).

    geoid gives its height over the ellipsoid, to be taken off height_m. Worked out
    once for each station and day, and joined to its rows then.
    """
    lat, lon, mjd = F.col("lat"), F.col("lon"), F.col("mjd")
    out = {"dry_c": dry_c(lat, mjd)}
    for name, key in (("dry", "dry_a"), ("wet", "wet_a")):
        if name in models:
            out[key] = models[name].at(lat, lon, mjd) * 1e-5
    height = F.col("height_m") - (geoid.at(lat, lon) if geoid else 0.0)
    if "pressure" in models:
        out["pressure_hpa"] = pressure_at(height, models["pressure"].at(lat, lon, mjd))
    if "temperature" in models:
        out["temperature_c"] = temperature_at(height, models["temperature"].at(lat, lon, mjd))
    return days.withColumns(out)


def read_grid(spark: SparkSession, paths: str | list[str], values: Sequence[str] = ("ah", "aw", "dry_m", "wet_m")) -> DataFrame:
    """(epoch, lat, lon, values) of files of one epoch each: lines of latitude, longitude (degrees) and values; ! begins a comment. epoch is the file's name."""
    part = F.split(F.trim("value"), " +")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    rows = spark.read.text(paths).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("epoch"), "value").where(~F.trim("value").startswith("!"))
    names = ["lat", "lon", *values]
    return rows.select("epoch", *[number(k).alias(n) for k, n in enumerate(names)]).dropna()


def gridded(sites: DataFrame, grid: DataFrame, values: Sequence[str], north: float, step_lat: float, west: float, step_lon: float, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """sites (keys, lat, lon in degrees) with values between the four nodes around them; null where a node is missing.

    Nodes lie step_lat degrees apart from north downwards, and step_lon from west
    around the globe. A site meets its nodes by equality of their numbers.
    """
    around = round(360 / step_lon)
    i, j = (north - F.col("lat")) / step_lat, F.pmod(F.col("lon") - west, F.lit(360.0)) / step_lon
    row, column = (lambda c: F.round((north - F.col(c)) / step_lat).cast("int")), (lambda c: F.pmod(F.round((F.col(c) - west) / step_lon), F.lit(around)).cast("int"))
    nodes = grid.select(*[F.col(k).alias(f"_{k}") for k in keys], row("lat").alias("_r"), column("lon").alias("_c"), *[F.col(v).alias(f"_{v}") for v in values])
    nodes = nodes.dropDuplicates([*[f"_{k}" for k in keys], "_r", "_c"])
    last = F.floor(i) - F.when((F.floor(i) == i) & (F.col("lat") <= north - 180), 1).otherwise(0)  # the last row belongs to the cell above it
    at = sites.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_i": last.cast("int"), "_j": F.floor(j).cast("int")}).withColumns({"_u": i - F.col("_i"), "_v": j - F.col("_j")})
    corner = F.array(*[F.struct((F.col("_i") + a).alias("r"), F.pmod(F.col("_j") + b, F.lit(around)).alias("c"), ((F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    rows = at.withColumn("_n", F.explode(F.filter(corner, lambda x: x["w"] > 0)))
    joined = rows.join(nodes, [*[rows[k] == nodes[f"_{k}"] for k in keys], rows["_n.r"] == nodes["_r"], rows["_n.c"] == nodes["_c"]], "left")
    mean = lambda v: F.when(F.count(f"_{v}") == F.count("*"), F.sum(F.col("_n.w") * F.col(f"_{v}"))).alias(v)
    found = joined.groupBy("_id").agg(*[F.first(c, False).alias(c) for c in sites.columns], *[mean(v) for v in values])
    return found.drop("_id")
