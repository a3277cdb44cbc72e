"""Positions and slant delays from events taken as observations: a user is a receiver, eight events are an epoch's satellites."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..operators import ambiguities as A, positioning as P
from .registry import query, rounded, table


def sky(spark, sf_dir):
    """events with station, t and k (epoch and satellite), el and az (degrees), the unit vector ux, uy, uz and the true receiver rx, ry, rz, clock (m)."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value").cast("double") % 7 - 3).alias("noise"), n.alias("n"))
    e = e.select("event_id", F.col("user_id").alias("station"), (F.col("n") / 8).cast("int").alias("t"), (F.col("n") % 8).cast("int").alias("k"), "noise")
    el, az = F.radians(15 + (F.col("event_id") * 7 + F.col("k") * 31) % 70), F.radians((F.col("k") * 45 + F.col("event_id") % 37).cast("double"))
    e = e.withColumns({"ux": F.sin(el), "uy": F.cos(el) * F.cos(az), "uz": F.cos(el) * F.sin(az), "el": el})
    return e.withColumns({"rx": 6378137.0 + F.col("station") * 10, "ry": F.col("station") * 100.0, "rz": F.col("station") * 50.0, "clock": 1000.0 + F.col("station")})


def codes(spark, sf_dir):
    """sky with satellites' places and codes of some metres' noise."""
    e = sky(spark, sf_dir)
    return e.withColumns({f"s{c}": F.col(f"r{c}") + 2.2e7 * F.col(f"u{c}") for c in "xyz"}).withColumn("p", 2.2e7 + F.col("clock") + F.col("noise"))


def step_sql() -> str:
    """One step from a start 100 m off, with the sums and the elimination written out."""
    e = "e0 e1 e2 1".split()
    sums = ", ".join([f"sum(w * {e[i]} * {e[j]}) as m{i}{j}" for i, j in P.UPPER] + [f"sum(w * {e[i]} * r) as r{i}" for i in range(4)])
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    steps, names = [], []
    for j in range(4):
        steps.append([f"{m(j, j)}" + "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j)) + f" as d{j}"])
        steps.append([f"({m(i, j)}" + "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j)) + f") / d{j} as l{i}{j}" for i in range(j + 1, 4)] + [f"r{j}" + "".join(f" - l{j}{k} * y{k}" for k in range(j)) + f" as y{j}"])
    for i in reversed(range(4)):
        steps.append([f"y{i} / d{i}" + "".join(f" - l{k}{i} * x{k}" for k in range(i + 1, 4)) + f" as x{i}"])
    text = f"select station, t, count(*) as many, {sums} from o group by station, t"
    for s in steps:
        text = f"select *, {', '.join(s)} from ({text})"
    return f"""with a as (select event_id, user_id as station, value % 7 - 3 as noise, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
b as (select *, n // 8 as t, n % 8 as k from a),
c as (select *, radians(15 + (event_id * 7 + k * 31) % 70) as el, radians(k * 45 + event_id % 37) as az, 6378137.0e0 + station * 10 as rx, station * 100.0e0 as ry, station * 50.0e0 as rz from b),
d as (select *, rx + 2.2e7 * sin(el) as sx, ry + 2.2e7 * cos(el) * cos(az) as sy, rz + 2.2e7 * cos(el) * sin(az) as sz, 2.2e7 + 1000 + station + noise as p, sin(el) * sin(el) as w, rx + 100 as x, ry - 50 as y, rz + 70 as z from c),
f as (select *, sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y) + (sz - z) * (sz - z)) as rho from d),
o as (select *, (x - sx) / rho as e0, (y - sy) / rho as e1, (z - sz) / rho as e2, p - rho as r from f),
g as ({text})
select event_id, round(case when many >= 4 then x + x0 end, 2) as x, round(case when many >= 4 then y + x1 end, 2) as y, round(case when many >= 4 then z + x2 end, 2) as z,
round(case when many >= 4 then x3 end, 2) as clock_m, round(r, 3) + 0.0 as residual from o join g using (station, t)"""


@query(step_sql())
def position_step(spark, sf_dir):
    o = codes(spark, sf_dir).withColumns({"x": F.col("rx") + 100, "y": F.col("ry") - 50, "z": F.col("rz") + 70, "clock_m": F.lit(0.0)})
    found = P.position_step(o, ["station", "t"], "p", ("sx", "sy", "sz"), ["x", "y", "z", "clock_m"], F.sin("el") * F.sin("el"))
    return found.select("event_id", *[F.round(c, 2).alias(c) for c in ("x", "y", "z", "clock_m")], rounded("residual", "residual", 3))


@query()
def single_point(spark, sf_dir):
    """Where the receivers stand, from codes alone: iterated from the closed solution, without codes that are off."""
    found = P.positions(codes(spark, sf_dir), ["station", "t"], weight=F.sin("el") * F.sin("el"))
    return found.select("event_id", *[F.round(c, 2).alias(c) for c in ("x", "y", "z", "clock_m", "residual_m")], "used")


def observed(e: Column, delay: Column, ambiguity: Column | float = 0.0) -> Column:
    return e + F.col("clock") + 0.15 / F.sin("el") + delay + ambiguity


@query()
def slant_filter(spark, sf_dir):
    """Slant delays of all receivers by the filter; satellites leave, come and slip."""
    e = sky(spark, sf_dir).where("(station + k + t) % 9 <> 0").withColumn("ratio", F.lit((1575.42 / 1227.60) ** 2))
    off = -(0.5 * F.col("ux") - 0.3 * F.col("uy") + 0.2 * F.col("uz"))
    delay, small = 2 + 3 / F.sin("el"), F.col("noise") / 1000
    amb = F.col("k") * 3.0 + F.when(F.col("t") >= 4, 11.0).otherwise(0.0)
    rows = e.select(
        "event_id", "station", (F.col("t") * 30.0).alias("t"), F.concat(F.lit("G0"), F.col("k").cast("string")).alias("sat"), F.col("t").isin(0, 4).alias("slip"), F.col("ux").alias("ex"), F.col("uy").alias("ey"), F.col("uz").alias("ez"),
        (1 / F.sin("el")).alias("wet"), "ratio", F.col("el").alias("elevation"), observed(off, delay, F.col("noise") / 10).alias("code1"), observed(off, delay * F.col("ratio"), F.col("noise") / 12).alias("code2"),
        observed(off, -delay, amb + small).alias("phase1"), observed(off, -delay * F.col("ratio"), amb * 2 - small).alias("phase2"),
    )
    return P.filtered_positions(rows).select("event_id", "used", *[F.round(c, 5).alias(c) for c in P.RESULTS])


#: Ambiguities of three satellites whose errors go along u: covariance 0.02 on the diagonal and u u'.
ALONG = (0.5, 0.4, -0.3)


def fixed_sql() -> str:
    """The nearest of all whole vectors around the rounded ones; the inverse of the covariance is known in closed form."""
    d = "abc"
    length = sum(u * u for u in ALONG) / 0.02
    quadratic = f"(({' + '.join(f'pow({c} - n{c}, 2)' for c in d)}) / 0.02e0 - pow({' + '.join(f'({u}e0) * ({c} - n{c})' for u, c in zip(ALONG, d, strict=True))}, 2) / {0.0004 * (1 + length)!r}e0)".replace("e-05e0", "e-5")
    return f"""with e as (select user_id, max(value) / 7.0e0 as a, min(value) / 3.0e0 + 0.3 as b, avg(value) / 11.0e0 as c from events group by user_id),
r as (select e.*, round_even(a, 0) + x as na, round_even(b, 0) + y as nb, round_even(c, 0) + z as nc from e, range(-4, 5) as p(x), range(-4, 5) as q(y), range(-4, 5) as s(z)),
q as (select user_id, na, nb, nc, {quadratic} as d from r),
m as (select user_id, min(struct_pack(d := d, na := na, nb := nb, nc := nc)) as best from q group by user_id)
select user_id, t.name, cast(case t.name when 'A' then best.na when 'B' then best.nb else best.nc end as bigint) as fixed from m, (values ('A'), ('B'), ('C')) as t(name)"""


@query(fixed_sql())
def fixed_ambiguities(spark, sf_dir):
    """Whole numbers nearest in the metric of the covariance, by reduction and search."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 7.0).alias("a"), (F.min("value") / 3.0 + 0.3).alias("b"), (F.avg("value") / 11.0).alias("c"))
    covariance = [u * w + (0.02 if i == j else 0.0) for i, u in enumerate(ALONG) for j, w in enumerate(ALONG)]
    groups = e.select("user_id", F.array(*map(F.lit, "ABC")).alias("names"), F.array("a", "b", "c").alias("values"), F.array(*map(F.lit, covariance)).alias("covariance"))
    return A.fixed(groups, ["user_id"], 0.0).select("user_id", "name", "fixed")
