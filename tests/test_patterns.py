import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tecflow.functions import corrections as C
from tecflow.plans import model as M
from tecflow.sources import products


def padded(body, label):
    return f"{body:<60}{label}\n"


def antenna(name, serial, dazi, zen, rows, bands=("G01",), since=None, until=None):
    text = padded("", "START OF ANTENNA") + padded(f"{name:<20}{serial:<20}", "TYPE / SERIAL NO") + padded(f"  {dazi:6.1f}", "DAZI") + padded(f"  {zen[0]:6.1f}{zen[1]:6.1f}{zen[2]:6.1f}", "ZEN1 / ZEN2 / DZEN")
    for day, label in ((since, "VALID FROM"), (until, "VALID UNTIL")):
        if day:
            text += padded(f"{day.year:6d}{day.month:6d}{day.day:6d}     0     0    0.0000000", label)
    for band in bands:
        text += padded(f"   {band}", "START OF FREQUENCY") + padded(f"{1:10.2f}{2:10.2f}{3:10.2f}", "NORTH / EAST / UP")
        for key, values in rows:
            text += f"{key:>8}" + "".join(f"{v:8.2f}" for v in values) + "\n"
        text += padded(f"   {band}", "END OF FREQUENCY")
    return text + padded("", "END OF ANTENNA")


def value(a, z):
    return round(z * z / 100 + 3 * math.cos(math.radians(a)), 2)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    zen = [5.0 * i for i in range(19)]
    rows = [("NOAZI", [z / 10 for z in zen])] + [(f"{a:.1f}", [value(a, z) for z in zen]) for a in range(0, 361, 30)]
    text = antenna("TRM59800.00     NONE", "", 30, (0, 90, 5), rows, ("G01", "G02"))
    text += antenna("BLOCK IIF", "G01", 0, (0, 14, 1), [("NOAZI", [float(i) for i in range(15)])], until=date(2020, 1, 1))
    text += antenna("BLOCK IIIA", "G01", 0, (0, 14, 1), [("NOAZI", [2.0 * i for i in range(15)])], since=date(2020, 1, 2))
    text += antenna("TORN", "", 30, (0, 90, 5), rows[:5])
    at = tmp_path_factory.mktemp("atx") / "a.atx"
    at.write_text(text)
    return str(at)


def test_patterns_are_read_and_chosen_by_day(spark, file):
    got = products.read_patterns(spark, file).collect()
    assert [(r.key, r.frequency, r.azimuth_step, len(r.grid_mm)) for r in got] == [("TRM59800.00     NONE", "G01", 30.0, 247), ("TRM59800.00     NONE", "G02", 30.0, 247), ("G01", "G01", 0.0, 15), ("G01", "G01", 0.0, 15), ("TORN", "G01", 0.0, 19)]
    for day, last in ((date(2019, 5, 1), 14.0), (date(2024, 3, 24), 28.0)):
        one = products.read_patterns(spark, file, day).where("kind = 'satellite'").collect()
        assert [r.grid_mm[-1] for r in one] == [last]


def test_values_between_nodes(spark, file):
    grid = products.read_patterns(spark, file).where("frequency = 'G01' and kind = 'receiver' and azimuth_step > 0")
    at = [(z, a) for z in (0.0, 2.5, 44.9, 90.0, 95.0, -3.0) for a in (0.0, 17.0, 359.0, 360.0, -1.0, 720.5)]
    rows = spark.createDataFrame(at, "z double, a double").join(grid)
    for r in rows.select("z", "a", C.pattern_value(*[F.col(c) for c in M.PATTERN], F.col("z"), F.col("a")).alias("v")).collect():
        z, a = min(max(r.z, 0), 90), r.a % 360
        i, j = min(int(z // 5), 17), int(a // 30)
        u, v = z / 5 - i, a / 30 - j
        want = sum(w * value(30 * (j + y), 5 * (i + x)) for x, y, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)))
        assert abs(r.v - want) < 1e-9


def test_patterns_in_the_antenna_terms(spark, file):
    found = {(r.kind, r.frequency): r for r in products.read_patterns(spark, file, date(2024, 3, 24)).where("key <> 'TORN'").collect()}
    pattern = lambda r: (r.grid_mm, r.zenith_from, r.zenith_step, r.azimuth_step)
    cols = "grid_mm array<double>, zenith_from double, zenith_step double, azimuth_step double"
    sats = spark.createDataFrame([("G01", 1, 0.0, 0.0, 1.5, *pattern(found["satellite", "G01"]))], f"sat string, band int, x double, y double, z double, {cols}")
    recs = spark.createDataFrame([("ABCD", b, 0.0, 0.0, 0.1, *pattern(found["receiver", f"G0{b}"])) for b in (1, 2)], f"station string, band int, north double, east double, up double, {cols}")
    row = ("ABCD", "G01", 2.0e7, 1.2e7, 1.1e7, 6.0e6, 1.5e6, 1.5e6, 1.0e11, 5e10, 2e10, 1.1, 2.0)
    terms = spark.createDataFrame([row, ("NONE", "G02", *row[2:])], "station string, sat string, sx double, sy double, sz double, rx double, ry double, rz double, sun_x double, sun_y double, sun_z double, elevation double, azimuth double").cache()
    drop = lambda t: t.drop(*M.PATTERN)
    with_, without = ({r.station: r for r in M.antenna_terms(terms, *tables).collect()} for tables in ((sats, recs), (drop(sats), drop(recs))))
    s, r = row[2:5], row[5:8]
    sight = [a - b for a, b in zip(s, r, strict=True)]
    nadir = math.degrees(math.acos(sum(a * b for a, b in zip(s, sight, strict=True)) / math.hypot(*s) / math.hypot(*sight)))
    recv = spark.range(1).select(C.pattern_value(F.array(*map(F.lit, found["receiver", "G01"].grid_mm)), F.lit(0.0), F.lit(5.0), F.lit(30.0), F.lit(90 - math.degrees(1.1)), F.lit(math.degrees(2.0)))).first()[0]
    assert abs(with_["ABCD"].antenna1_m - without["ABCD"].antenna1_m - (2 * nadir + recv) / 1000) < 1e-9
    assert abs(with_["ABCD"].antenna2_m - without["ABCD"].antenna2_m - recv / 1000) < 1e-9
    assert with_["NONE"].antenna1_m == 0.0 == with_["NONE"].antenna2_m and set(with_["ABCD"].asDict()) == {*terms.columns, "antenna1_m", "antenna2_m"}
