"""Broadcast navigation files, RINEX 2 and 3, as one row for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import names as N
from .products import text_lines, time_of

#: Place of each element among a record's numbers, for systems with orbital elements; GPS weeks are counted in all but C.
ELEMENTS = {
    "af0": 0, "af1": 1, "af2": 2, "crs": 4, "dn": 5, "m0": 6, "cuc": 7, "ecc": 8, "cus": 9, "root_a": 10, "toe": 11, "cic": 12, "node": 13, "cis": 14,
    "incl": 15, "crc": 16, "perigee": 17, "node_rate": 18, "incl_rate": 19, "week": 21, "health": 24, "delay": 25, "sent": 27,
}
#: The same for R, whose records are places, speeds and pulls of Sun and Moon (km).
STATES = {"af0": 0, "af1": 1, "x": 3, "vx": 4, "ax": 5, "health": 6, "y": 7, "vy": 8, "ay": 9, "channel": 10, "z": 11, "vz": 12, "az": 13}
#: Seconds and weeks that the clock of C is behind.
LATE_S, LATE_WEEKS = 14, 1356
GPS_EPOCH = 315964800


def numbers(line: Column, start: int, count: int) -> Column:
    """count numbers of 19 columns from start on, counted from 0; D stands for E, a blank or broken one is null."""
    return F.array(*[F.translate(F.trim(F.substring(line, start + 1 + 19 * k, 19)), "Dd", "EE").try_cast("double") for k in range(count)])


def gps_seconds(t: Column) -> Column:
    """Seconds since 6 January 1980 by the clock that t is of."""
    return (N.seconds_since_1970(t) - GPS_EPOCH).cast("double")


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec, sat, toc, v): a record's name, time and numbers in order."""
    lines = text_lines(spark, paths)
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = lambda name: F.substring("value", 61, 20).startswith(name)
    known = lambda c: F.last(c, True).over(so_far)
    rows = lines.withColumns({
        "_old": known(F.when(mark("RINEX VERSION"), F.substring("value", 6, 1) == "2")),
        "_kind": known(F.when(mark("RINEX VERSION"), F.when(F.substring("value", 21, 1) == "G", "R").otherwise("G"))),
        "_body": known(F.when(mark("END OF HEADER"), True)),
    }).where(F.col("_body") & ~mark("END OF HEADER"))
    begins = F.when(F.col("_old"), F.col("value").rlike("^[ 0-9][0-9] [ 0-9][0-9] [ 0-9][0-9] ")).otherwise(F.col("value").rlike("^[A-Z][ 0-9][0-9] [0-9]{4} "))
    rows = rows.withColumn("_new", begins).withColumn("rec", F.sum(F.col("_new").cast("int")).over(so_far)).where("rec > 0")
    two = lambda at: F.trim(F.substring("value", at + 1, 2)).try_cast("int")
    year = F.when(F.col("_old"), two(3) + F.when(two(3) < 80, 2000).otherwise(1900)).otherwise(F.substring("value", 5, 4).try_cast("int"))
    part = lambda old, new: F.when(F.col("_old"), two(old)).otherwise(two(new))
    second = F.when(F.col("_old"), F.trim(F.substring("value", 18, 5)).try_cast("double")).otherwise(two(21).cast("double"))
    sat = F.when(F.col("_old"), F.concat("_kind", F.lpad(F.trim(F.substring("value", 1, 2)), 2, "0"))).otherwise(F.replace(F.substring("value", 1, 3), F.lit(" "), F.lit("0")))
    first = F.when(F.col("_new"), F.struct(sat.alias("sat"), time_of(year, part(6, 9), part(9, 12), part(12, 15), part(15, 18), second).alias("toc")))
    at = F.when(F.col("_old"), 3).otherwise(4)
    values = F.when(F.col("_new"), F.when(F.col("_old"), numbers(F.col("value"), 22, 3)).otherwise(numbers(F.col("value"), 23, 3))).otherwise(F.when(at == 3, numbers(F.col("value"), 3, 4)).otherwise(numbers(F.col("value"), 4, 4)))
    rows = rows.select("file", "rec", "line", first.alias("first"), values.alias("v"))
    parts = rows.groupBy("file", "rec").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("line", "v"))).alias("parts"))  # eight lines
    return parts.select("file", "rec", "first.sat", "first.toc", F.flatten(F.col("parts.v")).alias("v"))


def whole(places: list[int]) -> Column:
    """Whether a record has its time and the numbers at these places."""
    return F.col("toc").isNotNull() & F.forall(F.array(*map(F.lit, places)), lambda k: F.get("v", k).isNotNull())


def read_navigation(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Orbital elements of G, E, C and J: sat, toc, toc_s and toe_s (seconds since 6 January 1980 of GPS time), those in ELEMENTS, and toe_own_s, the reference in seconds of its own week.

    Records without a needed number go; of repeated ones (sat and toe) the one sent
    last stays.
    """
    r = records(spark, paths).where(F.substring("sat", 1, 1).isin(*"GECJ") & whole([k for n, k in ELEMENTS.items() if n not in ("delay", "sent")]))
    v = lambda name: F.get("v", F.lit(ELEMENTS[name]))
    late = F.substring("sat", 1, 1) == "C"
    week = v("week") + F.when(late, LATE_WEEKS).otherwise(0)
    r = r.select(
        "sat", "toc", (gps_seconds(F.col("toc")) + F.when(late, LATE_S).otherwise(0)).alias("toc_s"), (week * 604800 + v("toe") + F.when(late, LATE_S).otherwise(0)).alias("toe_s"), v("toe").alias("toe_own_s"),
        *[v(n).alias(n) for n in ELEMENTS if n not in ("toe", "week")], "file", "rec",
    )
    last = Window.partitionBy("sat", "toe_s").orderBy(F.desc_nulls_last(F.when(F.col("sent") < 9e8, F.col("sent"))), "file", "rec")
    return r.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "file", "rec", "sent")


def read_navigation_states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """States of R: sat, toc (UTC), toe_s (seconds since 6 January 1980 of GPS time), those in STATES, in metres; one of each sat and time."""
    r = records(spark, paths).where((F.substring("sat", 1, 1) == "R") & whole(list(STATES.values())))
    v = lambda name: F.get("v", F.lit(STATES[name])) * (1000 if name[-1] in "xyz" else 1)
    leap = N.leap_seconds(N.modified_julian(F.col("toc"))) - 19
    r = r.select("sat", "toc", (gps_seconds(F.col("toc")) + leap).alias("toe_s"), *[v(n).alias(n) for n in STATES], "file", "rec")
    one = Window.partitionBy("sat", "toe_s").orderBy("file", "rec")
    return r.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "file", "rec")
