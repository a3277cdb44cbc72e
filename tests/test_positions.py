import datetime

from pyspark.sql import functions as F

from tecflow.sources import positions as P


def test_positions_of_logs_lists_and_solutions(spark, tmp_path):
    (tmp_path / "a.log").write_text("INFO x\nOUTPUT " + "0 " * 10 + "1111.5 2222.5 3333.5 9\nOUTPUT " + "0 " * 10 + "4111.5 5222.5 6333.5 9\nOUTPUT short\nOUTPUT " + "0 " * 10 + "1 2 3\n")
    assert [tuple(r)[1:] for r in P.read_solver_positions(spark, f"{tmp_path}/a.log").collect()] == [(4111.5, 5222.5, 6333.5)]
    (tmp_path / "b.txt").write_text("abcd not here\nABCD 4000.5 5000.5 6000.5\nwxyz 1 2 3 ABCD 7000 8000 9000")
    stations = spark.createDataFrame([("abcd",), ("wxyz",)], "station string")
    assert [tuple(r) for r in P.read_site_positions(spark, f"{tmp_path}/b.txt", stations).collect()] == [("ABCD", 4000.5, 5000.5, 6000.5)]
    line = lambda i, k, v: f" {i:5d} {k:<6} ABCD  A {1:4d} 24:084:43200 m    2 {v:21.14E} {0.00123:11.5E}\n"
    (tmp_path / "c.snx").write_text("%=SNX 2.02\n+SOLUTION/APRIORI\n" + line(1, "STAX", 1.0) + "-SOLUTION/APRIORI\n+SOLUTION/ESTIMATE\n*INDEX\n" + line(1, "STAX", 4e6) + line(2, "STAY", 1.5e6) + line(3, "STAZ", -2e6) + "-SOLUTION/ESTIMATE\n%ENDSNX\n")
    (r,) = P.read_estimates(spark, f"{tmp_path}/c.snx").collect()
    assert (r.station, r.point, r.solution, r.x, r.y, r.z, r.z_sigma) == ("ABCD", "A", "1", 4e6, 1.5e6, -2e6, 0.00123)
    (tmp_path / "sites").write_text("abcd wxyz\ntoolong abcd\n")
    assert sorted(r.station for r in P.read_site_list(spark, f"{tmp_path}/sites").collect()) == ["ABCD", "WXYZ"]


def test_names_with_dates(spark):
    day = F.lit(datetime.date(2024, 3, 24))
    name = P.named_for(F.lit("<SITE><DOY>0.<YY>o <YYYY>-<MONTH>-<DAY> igs<GPSWD>.sp3 <GPSWD_B> <DOY_F>"), day, F.lit("abcd"))
    assert spark.range(1).select(name).first()[0] == "abcd0840.24o 2024-03-24 igs23070.sp3 23066 085"


def test_clocks_on_a_full_axis(spark):
    t = lambda h, s: datetime.datetime(2024, 3, 24, h, 0, s)
    clocks = spark.createDataFrame([("G01", t(0, 0), 1.0), ("G01", t(0, 29), 2.0), ("G01", t(1, 0), 3.0)], "sat string, ts timestamp_ntz, bias_s double")
    rows = {r.epoch: r.bias_s for r in P.on_axis(clocks).collect()}
    assert len(rows) == 2880 and rows[0] == 2.0 and rows[120] == 3.0 and rows[1] is None
