"""Column expressions on dual-frequency measurements: phases in cycles, ranges in metres."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Speed of light (m/s), ionospheric constant for electron content in TECU, carriers in Hz.
LIGHT, IONO = 299792458.0, 40.309e16
GPS = (1575.42e6, 1227.60e6)
GALILEO = (1575.42e6, 1176.45e6)
BEIDOU = (1561.098e6, 1268.52e6)
GLONASS_BASE, GLONASS_STEP = (1602.0e6, 1246.0e6), (562.5e3, 437.5e3)
#: Frequency channel of GLONASS slots 1 to 24.
GLONASS_CHANNELS = (1, -4, 5, 6, 1, -4, 5, 6, -2, -7, 0, -1, -2, -7, 0, -1, 4, -3, 3, 2, 4, -3, 3, 2)


def glonass(slot: Column) -> tuple[Column, Column]:
    """Carriers of a GLONASS slot; null for others."""
    channel = F.get(F.array(*map(F.lit, GLONASS_CHANNELS)), slot - 1)
    return tuple(base + channel * step for base, step in zip(GLONASS_BASE, GLONASS_STEP, strict=True))


def carriers(system: Column, prn: Column) -> tuple[Column, Column]:
    """Both carriers of a satellite, by system letter G, R, E or C."""
    slots = glonass(prn)
    of = {"G": GPS, "E": GALILEO, "C": BEIDOU}
    out = []
    for k in (0, 1):
        f = F.when(system == "R", slots[k])
        for letter, pair in of.items():
            f = f.when(system == letter, F.lit(pair[k]))
        out.append(f)
    return tuple(out)


def present(x: Column) -> Column:
    """Zero and NaN stand for a missing measurement."""
    return F.when((x != 0) & ~F.isnan(x), x)


def all_or_none(*columns: Column, zero_missing: bool = True) -> list[Column]:
    """The columns, all null where any is missing: null, NaN and, with zero_missing, zero."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (present(c).isNotNull() if zero_missing else c.isNotNull() & ~F.isnan(c))
    return [F.when(ok, c) for c in columns]


def geometry_free(l1: Column, l2: Column, f1: Column, f2: Column) -> Column:
    """Phase difference of both carriers in metres."""
    return LIGHT / f1 * l1 - LIGHT / f2 * l2


def slant_content(l4: Column, f1: Column, f2: Column) -> Column:
    """Electron content along the ray, in TECU, up to an arc's constant."""
    return l4 * f1 * f1 * f2 * f2 / ((f1 * f1 - f2 * f2) * IONO)


def rate(diff: Column, per_minute: float = 2.0) -> Column:
    """Change per minute, from a change between 30 s epochs."""
    return per_minute * diff


def widelane(l1: Column, l2: Column, c1: Column, c2: Column, f1: Column, f2: Column) -> Column:
    """Wide-lane ambiguity in cycles, from phases in cycles and codes in metres."""
    wave = LIGHT / (f1 - f2)
    return l1 - l2 - (f1 * c1 + f2 * c2) / (f1 + f2) / wave


def ionosphere_free(x1: Column, x2: Column, f1: Column, f2: Column) -> Column:
    return (f1 * f1 * x1 - f2 * f2 * x2) / (f1 * f1 - f2 * f2)


def bias_corrected(x: Column, satellite_ns: Column, receiver_ns: Column) -> Column:
    """Code difference in metres less its inter-frequency biases in ns; a missing bias counts as zero."""
    return x - LIGHT * 1e-9 * (F.coalesce(satellite_ns, F.lit(0.0)) + F.coalesce(receiver_ns, F.lit(0.0)))


def code_content(p4: Column, f1: Column, f2: Column) -> Column:
    """Electron content in TECU from a levelled code difference; null where absurd or not there."""
    content = p4 * f1 * f1 * f2 * f2 / ((f1 * f1 - f2 * f2) * IONO)
    return F.when(F.abs(content).between(1e-5, 1e5), content)


#: Fixed value: the ionospheric constant of the positioning chain, a little rounder than IONO.
IONO_POSITIONING = 40.3e16


def content_of_delay(metres: Column, f1: Column) -> Column:
    """Electron content in TECU from a slant delay on the first carrier; zero stays, unknown systems have none."""
    return F.when(metres != 0, metres * f1 * f1 / IONO_POSITIONING).otherwise(metres)


def receiver_delay(ns: Column, f1: Column, f2: Column) -> Column:
    """What a receiver's code bias in ns adds to its slant delays, in metres."""
    return f2 * f2 / (f1 * f1 - f2 * f2) * (ns * 1e-9 * LIGHT)


def vertical(content: Column, factor: Column) -> Column:
    return F.when(factor > 0.01, content / factor)


def linear_power(decibels: Column) -> Column:
    """Signal strength on a linear scale; null unless positive."""
    return F.when(decibels > 0, F.pow(F.lit(10.0), 0.1 * decibels))


def metres(cycles: Column, frequency: Column) -> Column:
    return cycles * LIGHT / frequency


def masked(x: Column, elevation: Column, least: float, keep_unknown: bool = False) -> Column:
    """x where the satellite stands high enough; with keep_unknown, also where its elevation is zero or missing."""
    high = F.coalesce(elevation >= least, F.lit(False))
    return F.when(high | (F.coalesce(elevation <= 0, F.lit(True)) if keep_unknown else F.lit(False)), x)


def classified(mean: Column, most: Column, threshold: float) -> Column:
    return F.when(mean > threshold, "exceeded").when(most > threshold, "partial").otherwise("normal")
