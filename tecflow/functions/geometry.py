"""Column expressions on coordinates. Angles are radians unless a name ends in _deg; heights and ranges are metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Mean Earth radius and shell heights in km, ellipsoid (m).
EARTH_KM, SHELL_MAP_KM, SHELL_IPP_KM = 6371.0, 350.0, 450.0
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Distance on a sphere, by half sines."""
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def wrapped_deg(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360)) - 180


def geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and ellipsoidal height of an Earth-fixed position, in closed form."""
    e2 = FLATTENING * (2 - FLATTENING)
    minor = SEMI_MAJOR * (1 - FLATTENING)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * SEMI_MAJOR, p * minor)
    lat = F.atan2(z + e2 / (1 - e2) * minor * F.pow(F.sin(t), 3), p - e2 * SEMI_MAJOR * F.pow(F.cos(t), 3))
    height = p * F.cos(lat) + z * F.sin(lat) - SEMI_MAJOR * F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return lat, F.atan2(y, x), height


def earth_fixed(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    e2 = FLATTENING * (2 - FLATTENING)
    n = SEMI_MAJOR / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def local(lat: Column, lon: Column, dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """East, north and up of an Earth-fixed difference seen from a place."""
    east = -F.sin(lon) * dx + F.cos(lon) * dy
    north = -F.sin(lat) * F.cos(lon) * dx - F.sin(lat) * F.sin(lon) * dy + F.cos(lat) * dz
    up = F.cos(lat) * F.cos(lon) * dx + F.cos(lat) * F.sin(lon) * dy + F.sin(lat) * dz
    return east, north, up


def elevation_azimuth(east: Column, north: Column, up: Column) -> tuple[Column, Column]:
    return F.atan2(up, F.sqrt(east * east + north * north)), F.pmod(F.atan2(east, north), F.lit(2 * math.pi))


def pierce_point(lat: Column, lon: Column, elevation: Column, azimuth: Column, shell_km: float = SHELL_IPP_KM, radius_km: float = EARTH_KM) -> tuple[Column, Column]:
    """Latitude and longitude where a ray meets a thin shell."""
    psi = math.pi / 2 - elevation - F.asin(F.cos(elevation) * (radius_km / (radius_km + shell_km)))
    at = F.asin(F.sin(lat) * F.cos(psi) + F.cos(lat) * F.sin(psi) * F.cos(azimuth))
    return at, lon + F.asin(F.sin(psi) * F.sin(azimuth) / F.cos(at))


def rotated(x: Column, y: Column, z: Column, axis: int, angle: Column) -> tuple[Column, Column, Column]:
    """Coordinates in axes turned by angle about axis 1, 2 or 3."""
    c, s = F.cos(angle), F.sin(angle)
    return {1: (x, c * y + s * z, c * z - s * y), 2: (c * x - s * z, y, c * z + s * x), 3: (c * x + s * y, c * y - s * x, z)}[axis]


def earth_rotated(x: Column, y: Column, z: Column, travel_s: Column) -> tuple[Column, Column, Column]:
    """Satellite position in the frame at reception, after the signal's travel time."""
    return rotated(x, y, z, 3, travel_s * 7.2921151467e-5)


def cell_upper(x: Column, start: float, size: float) -> Column:
    """Index of the cell (lo, hi] that holds x, from 0."""
    return F.ceil((x - start) / size) - 1


def cell_lower(x: Column, start: float, size: float) -> Column:
    """Index of the cell [lo, hi) that holds x, from 0."""
    return F.floor((x - start) / size)


def midpoint_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Plain mean of two places; not for pairs across the date line."""
    return (lat1 + lat2) / 2, (lon1 + lon2) / 2


def mapping(kind: int, elevation: Column, shell_km: float = SHELL_IPP_KM) -> Column:
    """Slant over vertical: 0 single layer, 1 modified single layer, 2 Foelsche-Kirchengast, 3 low-elevation damped, 4 Fanselow, 5 Klobuchar."""
    scale = (EARTH_KM + shell_km) / EARTH_KM
    bent = F.sin(math.pi / 2 - elevation) / scale
    if kind == 1:
        bent = F.sin(0.9782 * (math.pi / 2 - elevation)) / scale
    layer = 1 / F.sqrt(1 - bent * bent)
    if kind in (0, 1):
        return layer
    if kind == 2:
        return (1 + scale) / (F.sin(elevation) + F.sqrt(scale * scale - F.pow(F.cos(elevation), 2)))
    if kind == 3:
        return F.when(elevation < math.radians(40), F.sin(elevation + math.radians(50)) * layer).otherwise(layer)
    if kind == 4:
        root = lambda h: F.sqrt(F.pow(EARTH_KM * F.sin(elevation), 2) + 2 * EARTH_KM * h + h * h)
        return (root(shell_km + 70) - root(shell_km - 35)) / 105.0
    if kind == 5:
        return 1 + 16 * F.pow(0.53 - elevation / math.pi, 3)
    raise ValueError(f"mapping function {kind} is not known")


def obliquity(elevation: Column, shell_km: float = SHELL_MAP_KM) -> Column:
    """Squared secant factor 1 / (1 - r2 cos2 e); null at zero elevation, which stands for unknown."""
    ratio = EARTH_KM / (EARTH_KM + shell_km)
    return F.when(elevation != 0, 1 / (1 - F.pow(ratio * F.cos(elevation), 2)))
