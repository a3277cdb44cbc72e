"""Column expressions on times, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seconds_since_1970(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def modified_julian(t: Column) -> Column:
    """Whole modified Julian day of a time."""
    return (F.floor(seconds_since_1970(t) / 86400) + 40587).cast("long")


def gps_week(t: Column) -> Column:
    """Weeks since 6 January 1980."""
    return F.floor((seconds_since_1970(t) - 315964800) / 604800).cast("long")


def second_of_day(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")


def row_of_day(t: Column, step: int = 30) -> Column:
    """Number of the epoch of a day that a time falls in, from 1."""
    return F.floor(second_of_day(t) / step).cast("long") + 1


def nearest_row(t: Column, step: int = 30) -> Column:
    """Number of the nearest epoch, from 1."""
    return F.round(second_of_day(t) / step).cast("long") + 1


#: First modified Julian day of each count of leap seconds (TAI less UTC) from 2000 on.
LEAPS = {51544: 32, 53736: 33, 54832: 34, 56109: 35, 57204: 36, 57754: 37}


def leap_seconds(mjd: Column) -> Column:
    """Leap seconds on a modified Julian day; null before 2000."""
    out = F.lit(None).cast("int")
    for first, n in LEAPS.items():
        out = F.when(mjd >= first, n).otherwise(out)
    return out


def station_of_name(name: Column) -> Column:
    """The station code: the first four characters of a file name, in capitals."""
    return F.upper(F.substring(name, 1, 4))


def day_of_year(year: Column, day: Column) -> Column:
    """The date of a day of a year; null out of range."""
    return F.when(year.between(2000, 2099) & day.between(1, 366), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1))


def date_of_name(name: Column) -> Column:
    """Day in a file name; null without one, or if the first of these forms that it has is out of range.

    - yyyyddd: seven digits that start with 20, also inside a longer number;
    - a station, ddd0 and an ending yyo, yyd or yyn: ssssddd0.yyo as a whole name (also packed), or ddd0.yyo after a character that is no digit;
    - yyddd: a number of five digits.
    """
    low = F.lower(name)
    runs = F.split(low, "[^0-9]+")
    begin = lambda r: F.locate("20", r)
    long = F.get(F.filter(runs, lambda r: (F.locate("20", r) > 0) & (F.length(r) - F.locate("20", r) >= 6)), F.lit(0))
    digits = long.substr(begin(long), F.lit(7))
    pieces = F.split(low, "[.]")
    whole = lambda k: F.coalesce(F.get(pieces, F.lit(k)), F.lit(""))
    is_day = lambda left: F.right(left, F.lit(4)).rlike("^[0-9]{3}0$")
    is_year = lambda right: right.substr(1, 2).rlike("^[0-9]{2}$") & right.substr(3, 1).isin("o", "d", "n")
    packed = (F.size(pieces) == 2) | ((F.size(pieces) == 3) & whole(2).isin("gz", "z"))
    classic = (F.length(whole(0)) == 8) & whole(0).rlike("^[a-z0-9]+$") & is_day(whole(0)) & (F.length(whole(1)) == 3) & is_year(whole(1)) & packed
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("l"), F.slice(pieces, 2, F.size(pieces)).alias("r"))
    loose = F.get(F.filter(pairs, lambda x: is_day(x["l"]) & is_year(x["r"]) & ~F.right(x["l"], F.lit(5)).substr(1, 1).rlike("[0-9]") | is_day(x["l"]) & is_year(x["r"]) & (F.length(x["l"]) == 4)), F.lit(0))
    left, right = F.when(classic, whole(0)).otherwise(loose["l"]), F.when(classic, whole(1)).otherwise(loose["r"])
    five = F.get(F.filter(runs, lambda r: F.length(r) == 5), F.lit(0))
    number = lambda c: c.try_cast("int")
    return (
        F.when(digits.isNotNull(), day_of_year(number(digits.substr(1, 4)), number(digits.substr(5, 3))))
        .when(left.isNotNull(), day_of_year(2000 + number(right.substr(1, 2)), number(F.right(left, F.lit(4)).substr(1, 3))))
        .when(five.isNotNull(), day_of_year(2000 + number(five.substr(1, 2)), number(five.substr(3, 3))))
    )


def risk_flags(chain: Column, sampling: Column, foreign_sigma: Column | None = None, nav_fallback: Column | None = None) -> Column:
    """Flags of a result in fixed order; FORMAL_PIPELINE if there is none."""
    chain, sampling = F.upper(F.coalesce(chain, F.lit(""))), F.upper(F.coalesce(sampling, F.lit("")))
    tests = [
        ((chain != "") & (chain != "FORMAL"), "NON_FORMAL_CHAIN_LEVEL"),
        (chain == "EXPERIMENTAL", "EXPERIMENTAL_CHAIN_LEVEL"),
        (chain == "DEGRADED", "DEGRADED_CHAIN_LEVEL"),
        ((sampling != "") & (sampling != "STANDARD_30S"), "NON_STANDARD_SAMPLING_MODE"),
        (sampling == "EXPERIMENTAL_1S_RESAMPLED", "EXPERIMENTAL_1S_RESAMPLED"),
    ]
    if foreign_sigma is not None:
        tests.append((foreign_sigma, "NON_GPS_SIGMAPHI_EXPERIMENT"))
    if nav_fallback is not None:
        tests.append((nav_fallback, "NAV_FALLBACK_ENABLED"))
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    return F.when(F.size(found) == 0, F.array(F.lit("FORMAL_PIPELINE"))).otherwise(found)
