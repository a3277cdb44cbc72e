"""Satellites by broadcast records: suppliers give the elements, events ask for places."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import broadcast as B
from .registry import query, rounded, table

#: Elements of a record as text that both engines read, from a key n and an account a.
ELEMENTS = {
    "af0": "n * 1e-6", "af1": "a * 1e-15", "af2": "a * 0e0", "crs": "a / 100", "dn": "4.5e-9 + n * 1e-12", "m0": "n * 0.37e0", "cuc": "a * 4e-10", "ecc": "0.002e0 + n % 13 * 0.001e0",
    "cus": "a * 8e-10", "root_a": "5153.6e0 + n % 3", "cic": "a * 2e-11", "node": "n * 0.21e0", "cis": "a * -1e-11", "incl": "0.95e0 + n % 5 * 0.004e0", "crc": "200 + a / 100", "perigee": "n * 0.53e0",
    "node_rate": "-8e-9 - n * 1e-12", "incl_rate": "a * 1e-14", "health": "case when n % 11 = 0 then 1e0 else 0e0 end",
}


def broadcast_sql() -> str:
    anomaly = "m"
    for _ in range(B.ROUNDS):
        anomaly = f"m + ecc * sin({anomaly})"
    picked = ", ".join(f"{text} as {name}" for name, text in ELEMENTS.items())
    return f"""with s as (select s_suppkey as n, cast(s_acctbal as double) as a, 'G0' || (s_suppkey % 8 + 1) as sat, cast(s_suppkey // 8 * 7200 as double) as toe from supplier),
r as (select sat, toe, {picked} from s),
w as (select *, greatest(toe - 7200, coalesce((toe + lag(toe) over o) / 2, toe - 7200)) as begins, least(toe + 7200, coalesce((toe + lead(toe) over o) / 2, toe + 7200)) as ends,
coalesce((toe + lag(toe) over o) / 2 >= toe - 7200, false) as after from r where health = 0 window o as (partition by sat order by toe)),
e as (select event_id, 'G0' || (user_id % 9 + 1) as sat, cast(event_id * 37 % 90000 as double) as t from events),
j as (select e.event_id, e.t, w.*, e.t - toe as tk, root_a * root_a as ax from e left join w on e.sat = w.sat and (t > begins or (not after and t = begins)) and t <= ends),
k as (select *, sqrt(3.986005e14 / (ax * ax * ax)) + dn as mn, m0 + (sqrt(3.986005e14 / (ax * ax * ax)) + dn) * tk as m from j),
l as (select *, {anomaly} as ea from k),
p as (select *, 1 - ecc * cos(ea) as f, atan2(sqrt(1 - ecc * ecc) * sin(ea), cos(ea) - ecc) + perigee as u from l),
q as (select *, sin(2 * u) as s2, cos(2 * u) as c2 from p),
g as (select *, ax * f + crs * s2 + crc * c2 as rad, u + cus * s2 + cuc * c2 as lat, incl + incl_rate * tk + cis * s2 + cic * c2 as tilt, node + (node_rate - 7.2921151467e-5) * tk - 7.2921151467e-5 * toe as o from q),
h as (select *, rad * cos(lat) as px, rad * sin(lat) as qx from g)
select event_id, round(px * cos(o) - qx * cos(tilt) * sin(o), 1) + 0.0 as x, round(px * sin(o) + qx * cos(tilt) * cos(o), 1) + 0.0 as y, round(qx * sin(tilt), 1) + 0.0 as z, round((af0 + af1 * tk) * 1e6, 6) + 0.0 as clock_us from h"""


@query(broadcast_sql())
def broadcast_orbit(spark, sf_dir):
    """Place and clock by the nearest healthy record; null outside its time."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as n", "cast(s_acctbal as double) as a", "concat('G0', s_suppkey % 8 + 1) as sat", "cast(floor(s_suppkey / 8) * 7200 as double) as toe_s")
    records = s.select("sat", "toe_s", F.col("toe_s").alias("toc_s"), F.col("toe_s").alias("toe_own_s"), *[F.expr(text).cast("double").alias(name) for name, text in ELEMENTS.items()])
    targets = table(spark, sf_dir, "events").selectExpr("event_id", "concat('G0', user_id % 9 + 1) as sat", "cast(event_id * 37 % 90000 as double) as t")
    found = B.propagated(B.chosen(targets, records))
    return found.select("event_id", *[rounded(c, c, 1) for c in "xyz"], rounded(F.col("clock_s") * 1e6, "clock_us"))
