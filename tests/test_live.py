import time
from datetime import datetime, timedelta

from tecflow.streaming import live

START = datetime(2024, 1, 1)


def stream_of(spark, path, rows, kinds):
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], kinds).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_windows_and_passes(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "G01", float(m % 7)) for m in range(0, 190)] + [(START + timedelta(hours=9), "G01", 0.0)]
    s = stream_of(spark, str(tmp_path / "in"), rows, "ts timestamp, sat string, v double")
    got = {r.start: (r.rms, r.n) for r in drained(live.windowed_rms(s, "ts", ["sat"], "v"), "rms", str(tmp_path / "c1"))}
    want = (sum((m % 7) ** 2 for m in range(60)) / 60) ** 0.5
    assert abs(got[START][0] - want) < 1e-9 and got[START][1] == 60
    passes = drained(live.passes_of(s, "ts", ["sat"]), "passes", str(tmp_path / "c2"))
    assert [(r.start, r.n) for r in passes] == [(START, 190)]


def test_state_equals_the_running_mean(spark, tmp_path):
    rows = [(START + timedelta(seconds=30 * k), 1 + k % 2, float(k % 5), float(k % 3)) for k in range(160)]
    s = stream_of(spark, str(tmp_path / "in"), rows, "ts timestamp, sat long, p4 double, l4 double")
    # Such a query runs empty triggers for ever, to see states time out; so its rows are waited for.
    df = live.live_smoothed(s, "sat", "ts", "p4", "l4")
    q = df.writeStream.format("memory").queryName("smooth").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    end = time.time() + 90
    while spark.table("smooth").count() < 160 and time.time() < end and not q.exception():
        time.sleep(0.5)
    q.stop()
    got = {(r.sat, r.ts): r.smoothed for r in spark.table("smooth").collect()}
    assert len(got) == 160
    for sat in (1, 2):
        total = 0.0
        for n, (ts, _, p4, l4) in enumerate([r for r in rows if r[1] == sat], 1):
            total += p4 + l4
            assert abs(got[sat, ts] - (total / n - l4)) < 1e-9
