import math
import random
from datetime import datetime, timedelta

import pytest

from tecflow.sources import rinex


def write(path, rng, epochs, end="\n", marker="ABCD"):
    lines = [f"{'     3.03':20s}{'OBSERVATION DATA':20s}{'M':20s}RINEX VERSION / TYPE", f"{marker:60s}MARKER NAME"]
    lines += [f"{'G    6 C1C L1C S1C C2W L2W S2W':60s}SYS / # / OBS TYPES", f"{'E    4 C1C L1C C5Q L5Q':60s}SYS / # / OBS TYPES", f"{'S    1 C1C':60s}SYS / # / OBS TYPES", f"{'':60s}END OF HEADER"]
    at = datetime(2024, 3, 24, 23, 50)
    for k in range(epochs):
        if k % 40 == 39:
            lines += [f"> {at:%Y %m %d %H %M} {at.second:2d}.0000000  4  1", f"{'a note':60s}COMMENT"]
        sats = [f"{s}{n:2d}" for s, n in [("G", 1), ("G", 12), ("E", 5), ("S", 20)] if rng.random() < 0.9]
        lines.append(f"> {at:%Y %m %d %H %M} {at.second:2d}.{at.microsecond:06d}0  0{len(sats):3d}")
        for s in sats:
            n = {"G": 6, "E": 4, "S": 1}[s[0]]
            lines.append(s + "".join(" " * 16 if rng.random() < 0.1 else f"{0.0 if rng.random() < 0.05 else rng.uniform(1, 3e7):14.3f}{rng.choice('  1'):2s}" for _ in range(n)).rstrip())
        at += timedelta(seconds=15, microseconds=rng.choice([0, 0, 1000]))
    path.write_bytes((end.join(lines) + end).encode())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = random.Random(3), tmp_path_factory.mktemp("obs")
    write(at / "abcd0840.24o", rng, 300)
    write(at / "efgh0840.24o", rng, 150, "\r\n", "")
    write(at / "none0840.24o", rng, 0)
    old = [f"{'     2.11':20s}{'OBSERVATION DATA':20s}{'G':20s}RINEX VERSION / TYPE", f"{'     1    C1':60s}# / TYPES OF OBSERV", f"{'':60s}END OF HEADER", " 24  3 24  0  0  0.0000000  0  1G 1", f"{20000000.0:14.3f}"]
    (at / "oldf0840.24o").write_text("\n".join(old))
    return str(at)


def rows(df):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=str)


def test_pieces_give_the_rows_of_whole_files(spark, folder):
    want = rows(rinex.read_observations(spark, folder).where("station <> 'OLDF'"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in ("1500", "4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = rinex.read_epochs(spark, folder)
            assert size == "128m" or df.rdd.getNumPartitions() > 10
            assert rows(df) == want
        assert df.columns == rinex.OBSERVATIONS.names and [f.dataType for f in df.schema] == [f.dataType for f in rinex.OBSERVATIONS]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r[0] for r in want} == {"ABCD", "EFGH"} and len(want) > 1000


def test_bounds_and_salts(spark, folder, monkeypatch):
    whole = rinex.read_epochs(spark, folder, "E")
    want = rows(whole.where("ts >= timestamp_ntz'2024-03-25 00:00:00' and ts < timestamp_ntz'2024-03-25 00:10:00'"))
    assert want and rows(rinex.read_epochs(spark, folder, "E", "2024-03-25 00:00:00", "2024-03-25 00:10:00")) == want
    monkeypatch.setattr(rinex, "HEADERS_SENT", 0)
    df = rinex.read_epochs(spark, folder, "E")
    assert rows(df) == rows(whole)
