"""Model corrections of ranges and phases, as column expressions. A vector is a triple of columns in metres, Earth-fixed."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Vector = tuple[Column, Column, Column]
#: Light (m/s), gravity of Earth, Sun and Moon (m3/s2), Earth's radius (m), astronomical unit (m), Love and Shida numbers of degree 2.
LIGHT, EARTH_GM, SUN_GM, MOON_GM, RADIUS, UNIT, LOVE, SHIDA = 299792458.0, 3.986004418e14, 1.32712440018e20, 4.9048695e12, 6378136.6, 149597870700.0, 0.6078, 0.0847


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, k: Column | float) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def plus(a: Vector, b: Vector, k: Column | float = 1.0) -> Vector:
    """a + k b."""
    return a[0] + b[0] * k, a[1] + b[1] * k, a[2] + b[2] * k


def unit(a: Vector) -> Vector:
    n = length(a)
    return a[0] / n, a[1] / n, a[2] / n


def sidereal(mjd: Column) -> Column:
    """Angle in radians between the vernal equinox and Greenwich, for a modified Julian date."""
    d = mjd - 51544.5
    return F.pmod(F.radians(280.46061837 + 360.98564736629 * d), F.lit(2 * math.pi))


def to_earth(v: Vector, mjd: Column) -> Vector:
    g = sidereal(mjd)
    return F.cos(g) * v[0] + F.sin(g) * v[1], F.cos(g) * v[1] - F.sin(g) * v[0], v[2]


def of_ecliptic(lon: Column, lat: Column, distance: Column, tilt: Column) -> Vector:
    x, y, z = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    return distance * x, distance * (F.cos(tilt) * y - F.sin(tilt) * z), distance * (F.sin(tilt) * y + F.cos(tilt) * z)


def sun(mjd: Column) -> Vector:
    """Earth-fixed position of the Sun to about a minute of arc."""
    d = mjd - 51544.5
    m = F.radians(357.5277233 + 35999.05034 * d / 36525)
    lon = F.radians(280.460 + 36000.770 * d / 36525) + F.radians(1.914666471 * F.sin(m) + 0.019994643 * F.sin(2 * m))
    distance = UNIT * (1.000140612 - 0.016708617 * F.cos(m) - 0.000139589 * F.cos(2 * m))
    return to_earth(of_ecliptic(lon, lon * 0, distance, F.radians(23.439291 - 0.0130042 * d / 36525)), mjd)


def moon(mjd: Column) -> Vector:
    """Earth-fixed position of the Moon to some tenths of a degree."""
    t = (mjd - 51544.5) / 36525
    el, sl, arg, far = (F.radians(a + b * t) for a, b in ((134.9, 477198.85), (357.5, 35999.05), (93.3, 483202.03), (297.9, 445267.11)))
    lon = F.radians(218.32 + 481267.883 * t) + F.radians(6.29 * F.sin(el) - 1.27 * F.sin(el - 2 * far) + 0.66 * F.sin(2 * far) + 0.21 * F.sin(2 * el) - 0.19 * F.sin(sl) - 0.11 * F.sin(2 * arg))
    lat = F.radians(5.13 * F.sin(arg) + 0.28 * F.sin(el + arg) - 0.28 * F.sin(arg - el) - 0.17 * F.sin(arg - 2 * far))
    parallax = F.radians(0.9508 + 0.0518 * F.cos(el) + 0.0095 * F.cos(el - 2 * far) + 0.0078 * F.cos(2 * far) + 0.0028 * F.cos(2 * el))
    return to_earth(of_ecliptic(lon, lat, RADIUS / F.sin(parallax), F.radians(23.439291 - 0.0130042 * t)), mjd)


def relativistic_clock(position: Vector, velocity: Vector) -> Column:
    """Seconds a satellite's clock is off by its orbit's eccentricity."""
    return -2 * dot(position, velocity) / LIGHT**2


def bending(satellite: Vector, receiver: Vector) -> Column:
    """Metres by which gravity lengthens the path."""
    s, r, d = length(satellite), length(receiver), length(plus(satellite, receiver, -1.0))
    return 2 * EARTH_GM / LIGHT**2 * F.log((s + r + d) / (s + r - d))


def satellite_axes(satellite: Vector, to_sun: Vector) -> tuple[Vector, Vector, Vector]:
    """Axes of a satellite in nominal attitude: z to the Earth, y across the Sun's direction, x completing them."""
    z = unit(scaled(satellite, -1.0))
    y = unit(cross(z, unit(plus(to_sun, satellite, -1.0))))
    return cross(y, z), y, z


def antenna_offset(satellite: Vector, to_sun: Vector, receiver: Vector, offset: Vector) -> Column:
    """Metres the range changes by the offset (x, y, z in satellite axes) of the antenna from the centre of mass."""
    x, y, z = satellite_axes(satellite, to_sun)
    shift = plus(plus(scaled(x, offset[0]), y, offset[1]), z, offset[2])
    return dot(shift, unit(plus(receiver, satellite, -1.0))) * -1


def receiver_offset(north_m: Column, east_m: Column, up_m: Column, elevation: Column, azimuth: Column) -> Column:
    """Metres the range shortens by a receiver antenna's offset."""
    return north_m * F.cos(elevation) * F.cos(azimuth) + east_m * F.cos(elevation) * F.sin(azimuth) + up_m * F.sin(elevation)


def dipole(a: Vector, b: Vector, sight: Vector, sign: float) -> Vector:
    """Effective dipole of crossed antennas a and b, seen along sight."""
    return plus(plus(a, sight, -dot(sight, a)), cross(sight, b), sign)


def dipole_angle(sent: Vector, received: Vector, sight: Vector) -> Column:
    """Radians from one dipole to the other about sight, in (-pi, pi]."""
    angle = F.acos(F.greatest(F.least(dot(sent, received) / (length(sent) * length(received)), F.lit(1.0)), F.lit(-1.0)))
    return F.when(dot(sight, cross(sent, received)) < 0, -angle).otherwise(angle)


def windup_angle(satellite: Vector, to_sun: Vector, receiver: Vector, north: Vector, west: Vector) -> Column:
    """Radians between the effective dipoles of both antennas, in (-pi, pi]; see operators.series.unwrapped."""
    x, y, _ = satellite_axes(satellite, to_sun)
    k = unit(plus(receiver, satellite, -1.0))
    return dipole_angle(dipole(x, y, k, -1.0), dipole(north, west, k, 1.0), k)


def solid_tide(site: Vector, body: Vector, body_gm: float) -> Vector:
    """Displacement of a site by the degree-2 tide of one body."""
    r, b = unit(site), unit(body)
    c = dot(r, b)
    size = body_gm / EARTH_GM * RADIUS**4 / F.pow(length(body), 3)
    along = scaled(r, size * LOVE * (1.5 * c * c - 0.5))
    return plus(along, plus(b, r, -c), size * 3 * SHIDA * c)


#: Love and Shida numbers of degree 2 at the equator's mean, their change with latitude, those of degree 3, masses of Sun and Moon over Earth's, equatorial radius (m).
LOVE_2, SHIDA_2, LOVE_LAT, SHIDA_LAT, LOVE_3, SHIDA_3, SUN_MASS, MOON_MASS, EQUATOR = 0.6078, 0.0847, -0.0006, 0.0002, 0.292, 0.015, 332946.0, 0.01230002, 6378137.0


def body_tide(site: Vector, lat: Column, to_sun: Vector, to_moon: Vector) -> Vector:
    """Displacement of a site by the tides of Sun and Moon to degree 2, with numbers that change with latitude, and of the Moon to degree 3."""
    return tide_of_units(unit(site), lat, (unit(to_sun), length(to_sun)), (unit(to_moon), length(to_moon)))


def tide_of_units(r: Vector, lat: Column, sun: tuple[Vector, Column], moon: tuple[Vector, Column]) -> Vector:
    """body_tide from unit vectors, and the distances (m) of Sun and Moon."""
    turn = 3 * F.pow(F.sin(lat), 2) - 1
    love, shida = LOVE_2 + LOVE_LAT * turn, SHIDA_2 + SHIDA_LAT * turn
    out = (F.lit(0.0),) * 3
    for (b, far), mass in ((sun, SUN_MASS), (moon, MOON_MASS)):
        c = dot(r, b)
        across = plus(b, r, -c)
        two = mass * EQUATOR**4 / F.pow(far, 3)
        out = plus(plus(out, r, two * love * (3 * c * c - 1) / 2), across, two * 3 * shida * c)
        if mass == MOON_MASS:
            three = mass * EQUATOR**5 / F.pow(far, 4)
            out = plus(plus(out, r, three * LOVE_3 * (2.5 * F.pow(c, 3) - 1.5 * c)), across, three * SHIDA_3 * (7.5 * c * c - 1.5))
    return out


def zenith_dry(pressure_hpa: Column, lat: Column, height_m: Column) -> Column:
    """Hydrostatic zenith delay in metres, with gravity at the site."""
    return 0.0022768 * pressure_hpa / (1 - 0.00266 * F.cos(2 * lat) - 0.28e-6 * height_m)


def zenith_wet(temperature_k: Column, vapour_hpa: Column) -> Column:
    return 0.002277 * (1255 / temperature_k + 0.05) * vapour_hpa


def pressure_at(height_m: Column, sea_level_hpa: float = 1013.25) -> Column:
    return sea_level_hpa * F.pow(1 - 2.2557e-5 * height_m, 5.2568)


def hopfield(pressure_hpa: Column, temperature_k: Column, vapour_hpa: Column) -> tuple[Column, Column]:
    """Dry and wet zenith delay by the two-quartic profile."""
    dry = 1e-6 / 5 * 77.64 * pressure_hpa / temperature_k * (40136 + 148.72 * (temperature_k - 273.16))
    wet = 1e-6 / 5 * (-12.96 * temperature_k + 371800) * vapour_hpa / F.pow(temperature_k, 2) * 11000
    return dry, wet


def chao_wet(temperature_k: Column, vapour_hpa: Column, lapse_k_m: float = 0.0065) -> Column:
    return 1.63e2 * F.pow(vapour_hpa, 1.23) / F.pow(temperature_k, 2) + 2.05e2 * lapse_k_m * F.pow(vapour_hpa, 1.46) / F.pow(temperature_k, 3)


def continued_fraction(elevation: Column, a: Column | float, b: Column | float, c: Column | float) -> Column:
    """The usual mapping of zenith delays, one at the zenith."""
    s = F.sin(elevation)
    return (1 + a / (1 + b / (1 + c))) / (s + a / (s + b / (s + c)))


def slant_delay(elevation: Column, dry_m: Column, wet_m: Column, dry: tuple[float, float, float] = (0.00127, 0.0029, 0.0629), wet: tuple[float, float, float] = (0.00058, 0.00143, 0.0434)) -> Column:
    return continued_fraction(elevation, *dry) * dry_m + continued_fraction(elevation, *wet) * wet_m


def davis_dry(pressure_hpa: Column, lat: Column, height_m: Column) -> Column:
    """Hydrostatic zenith delay with the constant of the revised refractivity."""
    return 0.0022768 * pressure_hpa / (1 - 0.0026 * F.cos(2 * lat) - 0.00028 * height_m / 1000)


def pattern_value(grid: Column, zenith_from: Column, zenith_step: Column, azimuth_step: Column, zenith_deg: Column, azimuth_deg: Column) -> Column:
    """Value of an antenna pattern (of read_patterns) between its four nodes; beyond the zeniths it has, that at the last one."""
    around = F.when(azimuth_step > 0, F.round(360 / azimuth_step) + 1).otherwise(1).cast("int")
    n = (F.size(grid) / around).cast("int")
    z = F.least(F.greatest((zenith_deg - zenith_from) / zenith_step, F.lit(0.0)), (n - 1).cast("double"))
    a = F.when(azimuth_step > 0, F.pmod(azimuth_deg, F.lit(360.0)) / azimuth_step).otherwise(0.0)
    i, j = F.floor(z).cast("int"), F.floor(a).cast("int")
    u, v = z - i, a - j
    node = lambda row, column: F.get(grid, F.least(row, around - 1) * n + F.least(column, n - 1))
    return (1 - v) * ((1 - u) * node(j, i) + u * node(j, i + 1)) + v * ((1 - u) * node(j + 1, i) + u * node(j + 1, i + 1))
