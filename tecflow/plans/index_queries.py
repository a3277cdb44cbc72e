"""The indices end to end on observations made from events: a user is a satellite seen by a station, its events are epochs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, signal as X
from . import indices as I
from .registry import query, rounded, table

F1, F2 = X.GPS
RADIUS = G.EARTH_KM + G.SHELL_IPP_KM
LEVELS, BOX, CELL = (0.01, 0.02, 0.05), (95.0, 35.0, 125.0, 50.0), (2.0, 1.0)


def observations(spark, sf_dir) -> DataFrame:
    """Epochs are numbered along a user's events; each 17th phase is missing, each 13th elevation unknown, each 11th strength low."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    epoch = F.row_number().over(w) + 100
    rows = e.select(
        "event_id", F.concat(F.lit("S"), (u % 5).cast("string")).alias("station"), F.lit("2024-03-24").cast("date").alias("date"), F.lit("G").alias("system"),
        F.concat(F.lit("G"), F.floor(u / 5).cast("string")).alias("sat"), (F.floor(u / 5) + 1).alias("prn"), epoch.alias("epoch"),
        F.when(i % 17 == 0, 0.0).otherwise(1000 + v / 1000).alias("l1"), F.lit(800.0).alias("l2"), (2e7 + i % 7).alias("c1"), (2e7 + v / 100).alias("c2"),
        (30 + v / 50).alias("s1"), F.when(i % 11 == 0, -1.0).otherwise(20 + v / 40).alias("s2"), F.when(i % 13 == 0, 0.0).otherwise(0.2 + i % 100 / 100.0).alias("elevation"),
    )
    return rows.withColumn("ipp_lat", 0.7 + F.substring("station", 2, 1).cast("int") * 0.02 + F.col("epoch") * 0.0003).withColumn("ipp_lon", 1.8 + F.substring("station", 2, 1).cast("int") * 0.03 + F.col("epoch") * 0.0002)


W = "(partition by station, sat order by epoch)"
BASE = f"""o as (select event_id, 'S' || (user_id % 5) as station, 'G' || (user_id // 5) as sat, row_number() over (partition by user_id order by ts, event_id) + 100 as epoch,
case when event_id % 17 = 0 then null else 1000 + value / 1000 end as l1, 800.0e0 as l2, 30 + value / 50 as s1, case when event_id % 11 = 0 then -1.0e0 else 20 + value / 40 end as s2,
case when event_id % 13 = 0 then 0.0e0 else 0.2e0 + event_id % 100 / 100.0e0 end as el, user_id % 5 as s from events),
p as (select *, {X.LIGHT!r}e0 / {F1!r}e0 * l1 - {X.LIGHT!r}e0 / {F2!r}e0 * l2 as l4, 0.7e0 + s * 0.02e0 + epoch * 0.0003e0 as lat, 1.8e0 + s * 0.03e0 + epoch * 0.0002e0 as lon from o),
c as (select *, l4 * {F1!r}e0 * {F1!r}e0 * {F2!r}e0 * {F2!r}e0 / (({F1!r}e0 * {F1!r}e0 - {F2!r}e0 * {F2!r}e0) * 40.309e16) as stec from p),
d as (select *, lead(stec) over {W} - stec as dstec from c)"""


def cleaned(source: str, value: str, jump: float, least: int, cap: float = 5.0) -> str:
    """SQL: arcs of present values, cut at their first jump, thrown out when short, and capped."""
    a = "(partition by station, sat, arc order by epoch)"
    return f"""v0 as (select *, {value} is not null as v, coalesce(lag({value} is not null) over {W}, false) as pv from {source}),
v1 as (select *, case when v then sum(case when v and not pv then 1 else 0 end) over (partition by station, sat order by epoch rows unbounded preceding) end as arc from v0),
v2 as (select *, case when abs({value} - lag({value}) over {a}) > {jump} then 1 else 0 end as j from v1),
v3 as (select *, max(j) over (partition by station, sat, arc order by epoch rows unbounded preceding) as b from v2),
v4 as (select *, sum(case when arc is not null and b = 0 then 1 else 0 end) over (partition by station, sat, arc) as n from v3),
v5 as (select *, case when arc is not null and b = 0 and n >= {least} and abs({value}) <= {cap} then {value} end as clean from v4)"""


def shown(df: DataFrame, value: str | Column, digits: int = 5) -> DataFrame:
    return df.select("event_id", rounded(value, "result", digits))


DEVIATION = f"""s as (select *, case when row_number() over {W} >= 10 and count(rot) over f >= {{least}} then {{f}}(rot) over f end as sd from r window f as (partition by station, sat order by epoch rows between 9 preceding and current row))"""


@query(f"""with {BASE}, r as (select *, 2.0e0 * dstec as rot from d), {DEVIATION.format(least=2, f="stddev_samp")}, x as (select *, lead(sd, 5) over {W} as roti from s), {cleaned("x", "roti", 2.5, 10)}
select event_id, round(clean, 5) + 0.0 as result from v5""")
def index_roti(spark, sf_dir):
    return shown(I.roti(observations(spark, sf_dir)), "roti")


@query(f"""with {BASE}, r as (select *, -2.0e0 * case when stec <> 0 and lag(stec) over {W} <> 0 then stec - lag(stec) over {W} end as rot from c), {DEVIATION.format(least=10, f="stddev_pop")}
select event_id, round(sd, 5) + 0.0 as result from s""")
def index_strict_roti(spark, sf_dir):
    return shown(I.strict_roti(observations(spark, sf_dir)), "roti")


RATE = f"r as (select *, coalesce(2.0e0 * dstec / case when el <> 0 then 1 / (1 - pow({G.EARTH_KM / (G.EARTH_KM + G.SHELL_MAP_KM)!r}e0 * cos(el), 2)) end, 2.0e0 * dstec / 2) as rate from d)"


@query(f"""with {BASE}, {RATE}, {cleaned("r", "rate", 5.2, 10)} select event_id, round(clean, 5) + 0.0 as result from v5""")
def index_along_arc(spark, sf_dir):
    return shown(I.along_arc_rate(observations(spark, sf_dir)), "iaatr")


@query(f"""with {BASE}, {RATE}, {cleaned("r", "rate", 5.2, 5)}, h as (select station, (epoch - 1) // 120 as hour, sqrt(avg(clean * clean)) as aatr from v5 group by all),
a as (select station, unnest(range(24)) as hour from (select distinct station from o))
select a.station, cast(a.hour as bigint) as hour, round(coalesce(aatr, 0), 5) + 0.0 as result from a left join h on a.station = h.station and a.hour = h.hour""")
def index_hourly_rate(spark, sf_dir):
    return I.hourly_rate(observations(spark, sf_dir)).select("station", "hour", rounded("aatr", "result", 5))


def variation_sql(band: str) -> str:
    return f"""{band}p as (select *, case when (degrees(el) >= 30 or el <= 0) and {band} > 0 then pow(10.0e0, 0.1e0 * {band}) end as w from o),
{band}x as (select *, case when count(w) over f = 10 and sum(w) over f > 0 then w / avg(w) over f end as x from {band}p window f as (partition by station, sat order by epoch rows between 10 preceding and 1 preceding)),
{band}y as (select event_id, case when count(x) over g = 10 then sqrt(greatest(avg(x * x) over g - avg(x) over g * avg(x) over g, 0.0)) / avg(x) over g end as y from {band}x window g as (partition by station, sat order by epoch rows between 9 preceding and current row))"""


@query(f"with {BASE}, {variation_sql('s1')}, {variation_sql('s2')} select a.event_id, round(a.y, 5) + 0.0 as s1, round(b.y, 5) + 0.0 as s2 from s1y a join s2y b on a.event_id = b.event_id")
def index_signal_variation(spark, sf_dir):
    df = I.signal_variation(observations(spark, sf_dir), detrend=10, size=10)
    return df.select("event_id", rounded("s4c_s1", "s1", 5), rounded("s4c_s2", "s2", 5))


def circle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * {RADIUS!r}e0 * asin(sqrt(least(pow(sin(({lat2} - {lat1}) / 2), 2) + cos({lat1}) * cos({lat2}) * pow(sin(({lon2} - {lon1}) / 2), 2), 1.0e0)))"


MOVED = f"""l as (select *, lead(lat) over {W} as lat2, lead(lon) over {W} as lon2 from d), m as (select *, {circle("lat", "lon", "lat2", "lon2")} as km from l),
g as (select *, case when km > 0 then 2 * abs(1e3 * dstec / km) end as crot from m)"""


@query(f"with {BASE}, {MOVED} select event_id, round(crot, 2) + 0.0 as result from g")
def index_gradient_rate(spark, sf_dir):
    return shown(I.gradient_rate(observations(spark, sf_dir)), "crot", 2)


#: The rates of index_gradient are whole numbers over a hundred, so that no level is met or missed by the last bit of a sine.
HITS = " + ".join(f"case when pow(abs(a.r - b.r) / {level!r}e0, 3) * (1000.0e0 / km) >= 1 then 1 else 0 end" for level in LEVELS)
PAIRS = f"""r as (select station, sat, epoch, lat, lon, (event_id * 37 % 900) / 100.0e0 as r, s from p where l1 is not null),
q as (select a.station as sa, b.station as sb, a.epoch, (degrees(a.lat) + degrees(b.lat)) / 2 as la, (degrees(a.lon) + degrees(b.lon)) / 2 as lo, a.r as ra, b.r as rb, {circle("a.lat", "a.lon", "b.lat", "b.lon")} as km
from r a join r b on a.sat = b.sat and a.epoch = b.epoch and a.station < b.station),
k as (select sa, sb, (epoch - 1) // 120 as hour, floor((la - {BOX[1]}) / {CELL[1]}) as i, floor((lo - {BOX[0]}) / {CELL[0]}) as j, case when km <= 1000 then {HITS.replace("a.r - b.r", "ra - rb")} else 0 end as n from q
where lo > {BOX[0]} and lo <= {BOX[2]} and la > {BOX[1]} and la <= {BOX[3]}), x as (select hour, sa, sb, i, j, max(n) as n from k group by all)"""
GRADIENT = f"with {BASE}, {PAIRS}"


def gradients(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rates = observations(spark, sf_dir).where("l1 <> 0").withColumn("crot", (F.col("event_id") * 37 % 900) / 100.0)
    return I.spatial_gradient(rates, LEVELS, BOX, CELL)


@query(f"{GRADIENT} select cast(hour as bigint) as hour, round(sum(n) / count(n), 6) + 0.0 as result from x group by hour")
def index_gradient(spark, sf_dir):
    return gradients(spark, sf_dir)[0].select(F.col("hour").cast("long").alias("hour"), rounded("index", "result"))


@query(f"{GRADIENT} select cast(hour as bigint) as hour, cast(i as bigint) as i, cast(j as bigint) as j, cast(max(n) as bigint) as result from x group by hour, i, j")
def index_gradient_map(spark, sf_dir):
    return gradients(spark, sf_dir)[1].select(*[F.col(c).cast("long").alias(c) for c in ("hour", "i", "j")], F.col("value").cast("long").alias("result"))


@query(f"""with {BASE}, m as (select (epoch - 1) // 120 as hour, ceil((degrees(lat) - 40.0e0) / 0.5e0) - 1 as i, ceil((degrees(lon) - 100.0e0) / 0.5e0) - 1 as j, stec from c where stec is not null)
select cast(hour as bigint) as hour, cast(i as bigint) as i, cast(j as bigint) as j, round(avg(stec), 5) + 0.0 as result, count(stec) as n from m group by hour, i, j""")
def index_map(spark, sf_dir):
    found = I.hourly_map(I.content(observations(spark, sf_dir)), "stec", 40.0, 100.0, 0.5)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("hour", "i", "j")], rounded("cell_mean", "result", 5), "n")


@query()
def index_levelled(spark, sf_dir):
    """Levelled content with arcs split by feedback, which SQL cannot follow; tests hold the steps apart."""
    obs = observations(spark, sf_dir)
    sats = obs.select("sat").distinct().select("sat", (F.length("sat") * 0.5).alias("ns"))
    stations = obs.select("station").distinct().select("station", F.lit(-1.5).alias("ns"))
    return I.levelled_content(obs, sats, stations, least=3).select("event_id", rounded("stec", "stec", 5), rounded("vtec", "vtec", 5))


@query()
def index_phase(spark, sf_dir):
    """The filtered phase index; its band-pass has a memory of twelve values and runs both ways."""
    df = observations(spark, sf_dir).withColumn("phase", F.col("l1") / 1000 + F.sin(F.col("epoch") * 2 * math.pi / 12) / 10)
    return shown(I.phase_index(df, "phase"), "sigma_phi")
