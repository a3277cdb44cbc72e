"""The indices end to end: observations and geometry in, index series out.

All work on long observation frames (station, system, sat, prn, ts, epoch, l1, l2,
c1, c2, s1, s2) and share one partitioning, by station, day and satellite.
Observations need a row for every epoch they span; see on_full_axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, signal as X
from ..operators import aggregates as A, grouped as P, joins as J, series as S
from ..sources.rinex import with_carriers

KEYS, ORDER = ["station", "date", "sat"], ["epoch"]
#: Caps and cleaning steps (jump, least values) of the indices; epochs an hour has.
ROTI_JUMP, AATR_JUMP, ROTI_LEAST, IAATR_LEAST, AATR_LEAST, CAP, HOUR = 2.5, 5.2, 10, 10, 5, 5.0, 120


def on_full_axis(obs: DataFrame, step: int = 30) -> DataFrame:
    """obs with date and a row for every epoch between a satellite's first and last one of the day."""
    rows = obs.withColumn("date", F.to_date("ts"))
    by = ["station", "date", "system", "sat", "prn"]
    span = rows.groupBy(*by).agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    axis = span.select(*by, F.explode(F.sequence("lo", "hi")).alias("epoch"))
    return axis.join(rows.drop("ts"), [*by, "epoch"], "left")


def content(obs: DataFrame) -> DataFrame:
    """obs with l4 (m) and stec (TECU) from both phases; zero is missing."""
    f = with_carriers(obs)
    l1, l2 = X.present(F.col("l1")), X.present(F.col("l2"))
    out = f.withColumn("l4", X.present(X.geometry_free(l1, l2, F.col("f1"), F.col("f2"))))
    return out.withColumn("stec", X.slant_content(F.col("l4"), F.col("f1"), F.col("f2")))


def changes(obs: DataFrame) -> DataFrame:
    """content with dstec to the next epoch and rot per minute."""
    out = S.forward_difference(content(obs), KEYS, ORDER, "stec", "dstec")
    return out.withColumn("rot", X.rate(F.col("dstec")))


def cleaned(df: DataFrame, value: str, jump: float, least: int) -> DataFrame:
    arcs = S.arcs(df, KEYS, ORDER, F.col(value).isNotNull())
    return S.capped(S.without_anomalies(arcs, KEYS, ORDER, value, jump, least), value, CAP).drop("arc")


def roti(obs: DataFrame, size: int = 10) -> DataFrame:
    """Rate-of-change index by epoch: deviation over size rates, stamped at the middle, cleaned and capped."""
    df = S.sliding_deviation(changes(obs), KEYS, ORDER, "rot", size, 1, 2, size // 2, "roti")
    return cleaned(df, "roti", ROTI_JUMP, ROTI_LEAST)


def strict_roti(obs: DataFrame, size: int = 10) -> DataFrame:
    """The other definition: backward differences, all of a window present, population deviation, stamped at its end."""
    df = S.backward_difference(content(obs), KEYS, ORDER, "stec", "dstec").withColumn("rot", -X.rate(F.col("dstec")))
    return S.sliding_deviation(df, KEYS, ORDER, "rot", size, 0, size, 0, "roti")


def along_arc_rate(obs: DataFrame, least: int = IAATR_LEAST) -> DataFrame:
    """Rate divided by obliquity, or half the rate where no elevation is known, cleaned and capped. obs has elevation in radians."""
    df = changes(obs)
    rate = F.coalesce(F.col("rot") / G.obliquity(F.col("elevation")), F.col("rot") / 2)
    return cleaned(df.withColumn("iaatr", rate), "iaatr", AATR_JUMP, least)


def hourly_rate(obs: DataFrame) -> DataFrame:
    """Root mean square of the along-arc rate over all satellites of an hour; an hour without any has 0."""
    return A.hourly_rms(along_arc_rate(obs, AATR_LEAST), ["station", "date", "system"], F.floor((F.col("epoch") - 1) / HOUR), "iaatr", "aatr")


def signal_variation(obs: DataFrame, least_elevation_deg: float = 30.0, detrend: int = 60, size: int = 60) -> DataFrame:
    """Signal strength variation of both carriers."""
    out = obs
    for band in ("s1", "s2"):
        power = X.linear_power(X.masked(F.col(band), F.degrees("elevation"), least_elevation_deg, keep_unknown=True))
        out = S.variation_index(out.withColumn("_p", power), KEYS, ORDER, "_p", detrend, size, f"s4c_{band}").drop("_p")
    return out


def gradient_rate(obs: DataFrame) -> DataFrame:
    """Change of content over the distance its pierce point moves. obs has ipp_lat and ipp_lon in radians."""
    w = S.along(KEYS, ORDER)
    df = changes(obs)
    moved = G.great_circle(F.col("ipp_lat"), F.col("ipp_lon"), F.lead("ipp_lat").over(w), F.lead("ipp_lon").over(w), G.EARTH_KM + G.SHELL_IPP_KM)
    return df.withColumn("moved_km", moved).withColumn("crot", F.when(F.col("moved_km") > 0, 2 * F.abs(1e3 * F.col("dstec") / F.col("moved_km"))))


def spatial_gradient(rates: DataFrame, levels: Sequence[float], box: tuple[float, float, float, float], cell_deg: tuple[float, float], reach_km: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(hourly index, hourly map) from gradient rates of all stations; box: least longitude, least latitude, greatest longitude, greatest latitude."""
    west, south, east, north = box
    pairs = J.station_pairs(rates.where("crot is not null"), "station", ["date", "sat", "epoch"], ["crot", "ipp_lat", "ipp_lon"])
    km = G.great_circle(F.col("ipp_lat_a"), F.col("ipp_lon_a"), F.col("ipp_lat_b"), F.col("ipp_lon_b"), G.EARTH_KM + G.SHELL_IPP_KM)
    counted = pairs.withColumn("n", J.gradient_counts(F.col("crot_a") - F.col("crot_b"), km, levels, reach_km))
    lon = lambda c: G.wrapped_deg(F.degrees(c))
    lat, mid = G.midpoint_deg(F.degrees("ipp_lat_a"), lon("ipp_lon_a"), F.degrees("ipp_lat_b"), lon("ipp_lon_b"))
    rows = counted.withColumn("lat", lat).withColumn("lon", mid).where((F.col("lon") > west) & (F.col("lon") <= east) & (F.col("lat") > south) & (F.col("lat") <= north))
    rows = rows.withColumn("hour", F.floor((F.col("epoch") - 1) / HOUR)).withColumn("i", G.cell_lower(F.col("lat"), south, cell_deg[1])).withColumn("j", G.cell_lower(F.col("lon"), west, cell_deg[0]))
    return J.gradient_index(rows, ["date", "hour"], ["station_a", "station_b"], ["i", "j"], "n")


def phase_index(corrected: DataFrame, phase_m: str, size: int = 10, cap_m: float = 5.0, sigma_cap_m: float = 1.0) -> DataFrame:
    """Filtered phase index of a phase in metres from which a model is already taken: slips out, band-pass by arc, sliding deviation."""
    df = S.without_jumps(corrected, KEYS, ORDER, phase_m, 2.0)
    df = S.arcs(df, KEYS, ORDER, F.col(phase_m).isNotNull())
    inside = P.band_filtered(df.where("arc is not null"), [*KEYS, "arc"], ORDER, phase_m)
    joined = df.drop("arc").join(inside.select(*KEYS, *ORDER, "filtered"), [*KEYS, *ORDER], "left")
    out = S.sliding_deviation(S.capped(joined, "filtered", cap_m), KEYS, ORDER, "filtered", size, 0, 2, 1, "sigma_phi")
    return S.capped(out, "sigma_phi", sigma_cap_m)


def model_removed(df: DataFrame, model: DataFrame, on: Sequence[str], value: str, correction: str) -> DataFrame:
    """value less its model correction; null where the model has none or zero."""
    m = model.select(*on, X.present(F.col(correction)).alias("_m"))
    return df.join(m, list(on), "left").withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def levelled_content(obs: DataFrame, satellite: DataFrame, receiver: DataFrame, how: str = "smooth", least: int = 20, mask_deg: float = 15.0, mapping: int = 0) -> DataFrame:
    """Slant and vertical content by carrier-to-code levelling: mask, arcs split at slips, smoothing or arc means, biases, mapping.

    satellite: sat, ns; receiver: station, ns, both of the code pair used.
    """
    c1, c2, l1, l2 = X.all_or_none(*[X.masked(F.col(c), F.degrees("elevation"), mask_deg) for c in ("c1", "c2", "l1", "l2")])
    f = with_carriers(obs)
    f1, f2 = F.col("f1"), F.col("f2")
    df = f.withColumn("p4", c2 - c1).withColumn("l4", X.geometry_free(l1, l2, f1, f2)).withColumn("lane", X.widelane(l1, l2, c1, c2, f1, f2))
    df = S.arcs(df, KEYS, ORDER, F.col("l4").isNotNull(), "run").where("run is not null")
    df = P.arcs_by_feedback(df, [*KEYS, "run"], ORDER, "lane", "l4", least).withColumn("arc", F.when(F.col("arc") >= 0, F.col("arc")))
    by = [*KEYS, "run"]
    df = S.smoothed(df, by, ORDER, "p4", "l4", warm=10, out="level") if how == "smooth" else S.levelled(df, by, "p4", "l4", out="level")
    both = J.biases(df, satellite, receiver, ["sat"], ["station"])
    level = X.bias_corrected(F.col("level"), F.col("satellite_ns"), F.col("receiver_ns"))
    out = both.withColumn("stec", X.code_content(level, f1, f2))
    return out.withColumn("vtec", X.vertical(F.col("stec"), G.mapping(mapping, F.col("elevation"))))


def seen_from(obs: DataFrame, orbits: DataFrame, stations: DataFrame) -> DataFrame:
    """obs with elevation, azimuth and pierce point (radians). orbits: sat, ts or epoch and date, x, y, z (m); stations: station, x, y, z (m)."""
    on = ["date", "sat", "epoch"]
    site = stations.select("station", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    lat, lon, _ = G.geodetic(F.col("_x"), F.col("_y"), F.col("_z"))
    site = site.withColumn("_lat", lat).withColumn("_lon", lon)
    rows = obs.join(orbits.select(*on, "x", "y", "z"), on, "left").join(site, "station", "left")
    enu = G.local(F.col("_lat"), F.col("_lon"), *[F.col(c) - F.col(f"_{c}") for c in "xyz"])
    el, az = G.elevation_azimuth(*enu)
    rows = rows.withColumn("elevation", el).withColumn("azimuth", az)
    ipp = G.pierce_point(F.col("_lat"), F.col("_lon"), F.col("elevation"), F.col("azimuth"))
    return rows.withColumn("ipp_lat", ipp[0]).withColumn("ipp_lon", ipp[1]).drop("_x", "_y", "_z", "_lat", "_lon")


def hourly_map(series: DataFrame, value: str, south: float, west: float, cell_deg: float) -> DataFrame:
    """Mean by hour and cell (lo, hi] of an index at its pierce points."""
    rows = series.where(F.col(value).isNotNull() & F.col("ipp_lat").isNotNull()).withColumn("hour", F.floor((F.col("epoch") - 1) / HOUR))
    rows = rows.withColumn("i", G.cell_upper(F.degrees("ipp_lat"), south, cell_deg)).withColumn("j", G.cell_upper(G.wrapped_deg(F.degrees("ipp_lon")), west, cell_deg))
    return A.cell_mean(rows, ["date", "hour"], ["i", "j"], value)


def elevation_deg(column: str = "elevation") -> Column:
    return F.col(column) * 180 / math.pi
