"""Operators with memory, on events; where SQL cannot express them, tests hold them against plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import grouped as P
from .registry import query, rounded, table


def series(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").cast("double").alias("value"))


@query()
def bandpass(spark, sf_dir):
    return P.band_filtered(series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("filtered", 6).alias("filtered"))


@query("""with recursive r as (select event_id, user_id, cast(value as double) as v, row_number() over (partition by user_id order by ts, event_id) as n from events),
k as (select event_id, user_id, n, v as m, (1 - 425.0e0 / 825.0e0) * 425.0e0 as p from r where n = 1 union all
select r.event_id, r.user_id, r.n, k.m + (k.p + 25.0e0) / (k.p + 25.0e0 + 400.0e0) * (r.v - k.m), (1 - (k.p + 25.0e0) / (k.p + 25.0e0 + 400.0e0)) * (k.p + 25.0e0) from k join r on r.user_id = k.user_id and r.n = k.n + 1)
select event_id, round(m, 6) as level, round(p, 6) as variance from k""")
def kalman(spark, sf_dir):
    return P.kalman(series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 25.0, 400.0).select("event_id", F.round("level", 6).alias("level"), F.round("variance", 6).alias("variance"))


@query()
def arc_feedback(spark, sf_dir):
    df = series(spark, sf_dir).withColumn("lane", F.col("value") / 400).withColumn("geometry", F.col("value") / 300)
    return P.arcs_by_feedback(df, ["user_id"], ["ts", "event_id"], "lane", "geometry", 3).select("event_id", "arc")


@query()
def outlier_fit(spark, sf_dir):
    return P.without_outliers(series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 1.5).select("event_id", "value")


def spline_sql() -> str:
    """The anchors of orbit_spline are fixed, and so are their slopes: here from all equations at once."""
    t = np.arange(97) * 900.0
    y = np.sin(np.arange(97) * 900 / 5000.0) * 2e7
    m, r = np.zeros((97, 97)), np.zeros(97)
    for i in range(1, 96):
        m[i, i - 1 : i + 2], r[i] = (900.0, 3600.0, 900.0), 3 * (y[i + 1] - y[i - 1])
    # The first two intervals have one third derivative, and so have the last two.
    for row, i in ((0, 0), (96, 94)):
        m[row, i], m[row, i + 2] = 900.0**2, -(900.0**2)
        r[row] = 2 * 900.0 * ((y[i + 1] - y[i]) - (y[i + 2] - y[i + 1]))
    s = np.linalg.solve(m, r)
    rows = ", ".join(f"({i}, {float(t[i])!r}e0, {float(y[i])!r}e0, {float(y[i + 1])!r}e0, {float(s[i])!r}e0, {float(s[i + 1])!r}e0)".replace("e+", "e").replace("e-05e0", "e-05") for i in range(96))
    return f"""with a(k, t, y0, y1, s0, s1) as (values {rows}), e as (select event_id, cast(event_id * 83 % 86400 as double) as s from events),
j as (select event_id, s - t as x, y0, s0, (3 * (y1 - y0) / 900 - 2 * s0 - s1) / 900 as c2, (s0 + s1 - 2 * (y1 - y0) / 900) / 810000 as c3 from e join a on k = floor(s / 900))
select event_id, round(y0 + x * (s0 + x * (c2 + x * c3)), 3) + 0.0 as x, round(s0 + x * (2 * c2 + 3 * x * c3), 5) + 0.0 as x_rate from j"""


@query(spline_sql())
def orbit_spline(spark, sf_dir):
    t = series(spark, sf_dir).select("event_id", F.lit("G01").alias("sat"), (F.col("event_id") * 83 % 86400).cast("double").alias("s"))
    anchors = spark.range(0, 97).select(F.lit("G01").alias("sat"), (F.col("id") * 900.0).alias("s"), (F.sin(F.col("id") * 900 / 5000.0) * 2e7).alias("x"))
    return P.splined(t, anchors, ["sat"], "s", ["x"], 900.0).select("event_id", rounded("x", "x", 3), rounded("x_rate", "x_rate", 5))


@query()
def slip_restart(spark, sf_dir):
    """Slips and repaired phases with means that start anew after a slip; held against plain loops in the tests."""
    df = series(spark, sf_dir).withColumns({"lane": F.col("value") / 25, "free": F.col("value") / 200, "elevation": F.lit(45.0), "l1": F.col("value") / 10, "l2": F.col("value") / 12})
    return P.slips_with_restart(df, ["user_id"], ["ts", "event_id"], "lane", "free", "elevation", ["l1", "l2"], (0.19029, 0.24421)).select("event_id", "slip", F.round("fixed1", 6).alias("fixed1"), F.round("fixed2", 6).alias("fixed2"))
