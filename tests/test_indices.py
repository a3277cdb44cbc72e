import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tecflow.functions import signal as X
from tecflow.plans import indices as I
from tecflow.sinks import files as K
from tecflow.sources import products, rinex, scan

C, (F1, F2) = X.LIGHT, X.GPS


def padded(body, label):
    return f"{body:<60}{label}\n"


def rinex3(station, stec, sats=("G01", "G05"), other=""):
    """A RINEX 3 file whose geometry-free phase gives stec(k) TECU at epoch k."""
    head = padded("     3.03           OBSERVATION DATA    M", "RINEX VERSION / TYPE") + padded(station, "MARKER NAME") + padded("  4321234.0000  1234567.0000  4321000.0000", "APPROX POSITION XYZ")
    head += padded("G    6 C1C L1C C2W L2W S1C S2W", "SYS / # / OBS TYPES") + padded(other, "SYS / # / OBS TYPES") * bool(other) + padded("    30.000", "INTERVAL") + padded("", "END OF HEADER")
    scale = F1**2 * F2**2 / ((F1**2 - F2**2) * X.IONO)
    out = [head]
    for k in range(len(stec)):
        out.append(f"> 2024 03 24 {k * 30 // 3600:02d} {k * 30 % 3600 // 60:02d} {k * 30 % 60:10.7f}  0{len(sats):3d}\n")
        for s in sats:
            l2 = 1e5
            l1 = (stec[k] / scale + C / F2 * l2) * F1 / C
            out.append(s + "".join(f"{v:14.3f}  " if i not in (1, 3) else f"{v:14.3f}  " for i, v in enumerate((2.1e7, round(l1, 3), 2.1e7 + 3, l2, 45.0, 40.0))) + "\n")
    return "".join(out)


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rinex")
    (d / "abcd0840.24o").write_text(rinex3("ABCD", [10 + 0.5 * k for k in range(240)], other="S    2 C1C L1C"))
    return rinex.read_observations(spark, str(d))


def test_observations_and_headers(spark, obs, tmp_path):
    rows = obs.where("sat = 'G05'").orderBy("epoch").collect()
    assert len(rows) == 240 and rows[0].station == "ABCD" and rows[0].prn == 5 and rows[-1].epoch == 240
    assert rows[0].c1 == 2.1e7 and rows[0].s2 == 40.0
    (tmp_path / "wxyz0840.24o").write_text(rinex3("WXYZ", [1.0], other="S    2 C1C L1C"))
    h = rinex.read_headers(spark, str(tmp_path)).first()
    assert h.version == "3.03" and h.interval_s == 30 and h.x == 4321234.0 and h.unsupported == ["S"] and h.obs_types["G"][1] == "L1C"


def test_version_2_with_continued_lines(spark, tmp_path):
    head = padded("     2.11           OBSERVATION DATA    M", "RINEX VERSION / TYPE") + padded("OLD1", "MARKER NAME") + padded("     6    L1    L2    C1    P2    S1    S2", "# / TYPES OF OBSERV") + padded("", "END OF HEADER")
    sats = [f"G{i:02d}" for i in range(1, 14)]
    body = " 24  3 24  0  0  0.0000000  0 13" + "".join(sats[:12]) + "\n" + " " * 32 + sats[12] + "\n"
    for i, _ in enumerate(sats):
        body += "".join(f"{v:14.3f}  " for v in (100 + i, 80, 2e7, 0.0, 45)) + "\n" + f"{41:14.3f}\n"
    (tmp_path / "old10840.24o").write_text(head + body)
    rows = rinex.read_observations(spark, str(tmp_path)).orderBy("prn").collect()
    assert [r.l1 for r in rows] == [100.0 + i for i in range(13)] and rows[12].sat == "G13" and rows[0].c2 is None and rows[0].s2 == 41


def test_steady_ramp_has_no_index_and_a_known_rate(obs):
    full = I.on_full_axis(obs)
    got = I.changes(full).where("epoch between 10 and 200").agg(F.avg("rot"), F.max(F.abs(F.col("rot") - 1.0))).first()
    assert abs(got[0] - 1.0) < 2e-2 and got[1] < 0.5
    assert I.roti(full).where("roti is not null").agg(F.max("roti")).first()[0] < 0.15
    assert I.strict_roti(full).where("roti is not null").count() == 2 * (240 - 10)


def test_hourly_rate_fills_empty_hours_with_zero(obs):
    full = I.on_full_axis(obs).withColumn("elevation", F.lit(math.pi / 2))
    rows = {r.hour: r.aatr for r in I.hourly_rate(full).collect()}
    assert len(rows) == 24 and rows[5] == 0 and abs(rows[0] - (1 - (6371 / 6721) ** 2 * math.cos(math.pi / 2) ** 2)) < 0.1


def test_signal_variation_of_steady_strength_is_zero(obs):
    full = I.on_full_axis(obs).withColumn("elevation", F.lit(1.0))
    got = I.signal_variation(full, detrend=20, size=20).where("s4c_s1 is not null").agg(F.max("s4c_s1"), F.count("*")).first()
    assert got[0] < 1e-6 and got[1] == 2 * (240 - 39)


def test_two_equal_stations_have_no_gradient(spark, obs):
    one = I.on_full_axis(obs).withColumn("ipp_lat", 0.8 + F.col("epoch") * 1e-5).withColumn("ipp_lon", F.lit(0.1) + F.col("prn") * 0.01)
    two = one.withColumn("station", F.lit("EFGH")).withColumn("ipp_lon", F.col("ipp_lon") + 0.01)
    index, grid = I.spatial_gradient(I.gradient_rate(one.union(two)), (5.0, 10.0), (-10.0, 30.0, 20.0, 60.0), (2.5, 2.5))
    assert {r["index"] for r in index.collect()} == {0.0} and grid.count() > 0
    step = I.gradient_rate(two).withColumn("crot", F.col("crot") + 100)
    index, _ = I.spatial_gradient(I.gradient_rate(one).union(step), (5.0, 10.0), (-10.0, 30.0, 20.0, 60.0), (2.5, 2.5))
    assert {r["index"] for r in index.collect()} == {2.0}


def test_levelling_finds_the_content(spark, obs):
    full = I.on_full_axis(obs).withColumn("elevation", F.lit(1.2))
    none = spark.createDataFrame([], "sat string, ns double"), spark.createDataFrame([], "station string, ns double")
    rows = I.levelled_content(full, *none, how="mean", least=10).where("stec is not null")
    assert rows.count() == 480
    spread = rows.agg(F.max("stec") - F.min("stec")).first()[0]
    assert abs(spread - 0.5 * 239) < 1


def test_orbits_clocks_antennas_and_biases(spark, tmp_path):
    sp3 = "#cP2024  3 24  0  0  0.00000000      96 ORBIT IGS14 HLM  IGS\n" + "".join(f"*  2024  3 24  0 {15 * k:2d}  0.00000000\nPG01{15000 + k:14.6f}{20000:14.6f}{5000:14.6f}{12.5:14.6f}\nPG02{0:14.6f}{0:14.6f}{0:14.6f}{999999.999999:14.6f}\n" for k in range(3))
    (tmp_path / "a.sp3").write_text(sp3)
    rows = products.read_orbits(spark, str(tmp_path / "a.sp3")).orderBy("ts").collect()
    assert [(r.sat, r.x_km, r.clock_us) for r in rows] == [("G01", 15000.0 + k, 12.5) for k in range(3)]
    assert str(rows[1].ts) == "2024-03-24 00:15:00"
    (tmp_path / "a.clk").write_text("AR ALBH 2024 03 24 00 00  0.000000  1   1.0E-09\nAS G07  2024 03 24 00 00 30.000000  2   -1.5E-04  1.0E-11\n")
    c = products.read_clocks(spark, str(tmp_path / "a.clk")).collect()
    assert [(r.sat, r.bias_s, str(r.ts)) for r in c] == [("G07", -1.5e-4, "2024-03-24 00:00:30")]
    atx = padded("", "START OF ANTENNA") + padded(f"{'BLOCK IIF':<20}{'G01':<20}", "TYPE / SERIAL NO") + padded("   G01", "START OF FREQUENCY") + padded(f"{394:10.2f}{0:10.2f}{1501.8:10.2f}", "NORTH / EAST / UP") + "   NOAZI    1.00   -0.50\n" + padded("   G01", "END OF FREQUENCY") + padded("", "END OF ANTENNA")
    (tmp_path / "a.atx").write_text(atx)
    a = products.read_antennas(spark, str(tmp_path / "a.atx")).first()
    assert (a.kind, a.key, a.frequency, a.up_mm, a.zenith_mm) == ("satellite", "G01", "G01", 1501.8, [1.0, -0.5])
    line = lambda key, site, v: f" DSB  G063 {key:<3} {site:<9} C1C  C2W  2024:084:00000 2024:085:00000 ns   {v:22.4f} {0.01:11.4f}\n"
    (tmp_path / "a.bsx").write_text(line("G01", "", -3.25) + line("G", "ABCD", 7.5) + "noise\n")
    b = {(r.scope, r.key, r.code1, r.code2, r.ns) for r in products.read_biases(spark, str(tmp_path / "a.bsx")).collect()}
    assert b == {("satellite", "G01", "C1C", "C2W", -3.25), ("receiver", "ABCD", "C1C", "C2W", 7.5)}


def test_scan_and_chain(spark, tmp_path):
    for n in ("yel20840.24o", "igs20240840000.sp3", "x2024084.clk", "igs14.atx", "notes.md"):
        (tmp_path / n).write_text("x")
    rows = {r.name: (r.kind, str(r.date), r.station) for r in scan.scan(spark, str(tmp_path)).collect()}
    assert rows["yel20840.24o"] == ("OBS", "2024-03-24", "YEL2") and rows["igs14.atx"][0] == "ATX" and "notes.md" not in rows
    day = scan.kinds_by_day(scan.scan(spark, str(tmp_path))).where("date = '2024-03-24'").first()
    assert day.chain == "FORMAL" and "ATX" in day.kinds


def test_writers(spark, tmp_path):
    rows = [(t, s, float(10 * t + s)) for t in range(5) for s in (1, 2) if (t, s) != (2, 2)]
    df = spark.createDataFrame(rows, "time int, sat int, v double")
    wide = K.wide_series(df, "time", "sat", "v", [1, 2])
    assert wide.columns == ["time", "value_000", "value_001"] and wide.count() == 5
    grid = spark.createDataFrame([(np.arange(12.0).reshape(3, 4).tolist(),)], "g array<array<double>>")
    assert sorted(map(tuple, K.long_grid(grid, "g").collect()))[-1] == (2, 3, 11.0)
    K.save_matrix(K.matrix_lines(df, "time", "sat", "v", [1, 2]), str(tmp_path / "m"))
    back = products.read_epoch_matrix(spark, str(tmp_path / "m"))
    assert back.where("epoch = 3 and column = 1").first().value == 31.0 and back.where("epoch = 2 and column = 2").first().value is None
    df.write.parquet(str(tmp_path / "a.parquet"))
    K.convert(spark, str(tmp_path / "a.parquet"), str(tmp_path / "a.json"))
    assert spark.read.json(str(tmp_path / "a.json")).count() == 9
    with pytest.raises(ValueError):
        K.convert(spark, str(tmp_path / "a.parquet"), str(tmp_path / "a.mat"))
    path = str(tmp_path / "t.parquet")
    K.upsert(spark, path, df, ["time", "sat"])
    out = K.upsert(spark, path, spark.createDataFrame([(0, 1, -1.0), (9, 9, 9.0)], df.schema), ["time", "sat"])
    assert out.count() == 10 and out.where("time = 0 and sat = 1").first().v == -1.0
    assert K.padded({"a": spark.createDataFrame([(0, 1.0), (1, 2.0)], "row int, value double"), "b": spark.createDataFrame([(0, 5.0)], "row int, value double")}).where("row = 1").first().b is None
