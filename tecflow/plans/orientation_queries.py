"""Events' places turned into the terrestrial frame, with daily parameters by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import orientation as O
from .registry import query, rounded, table


def number(x: float) -> str:
    return repr(x) if "e" in repr(x) else f"{float(x)!r}e0"


def orientation_sql() -> str:
    poly = lambda c, t: f"({number(c[0])} + {t} * ({number(c[1])} + {t} * ({number(c[2])} + {t} * ({number(c[3])}))))"
    s = number(O.SECOND)
    angle = lambda t: " + ".join(f"a{k} * {n}" for k, n in enumerate(t[:5]) if n)
    part = lambda f, i: " + ".join(f"{f}({angle(t)}) * ({number(t[i])} + c * ({number(t[i + 1])}))" for t in O.NUTATION)
    text = """select *, mjd + (tai + 32.184e0) / 86400 as tt, mjd + ut1 / 86400 as u from r"""
    text = f"select *, (tt - 51544.5e0) / 36525 as c, (u - 51544.5e0) / 36525 as v from ({text})"
    text = f"select *, {', '.join(f'{poly(a, chr(99))} * {s} as a{k}' for k, a in enumerate(O.ARGUMENTS))}, {poly(O.OBLIQUITY, 'c')} * {s} as e from ({text})"
    text = f"select *, ({part('sin', 5)}) * {s} * 1e-4 as dl, ({part('cos', 7)}) * {s} * 1e-4 as de from ({text})"
    gmst = f"({poly(O.SIDEREAL, 'v')} - 86400 * floor({poly(O.SIDEREAL, 'v')} / 86400)) * pi() / 43200"
    turns = [f"-{poly(O.ZETA, 'c')} * {s}", f"{poly(O.THETA, 'c')} * {s}", f"-{poly(O.Z, 'c')} * {s}", "e", "-dl", "-e - de", f"{gmst} + dl * cos(e) + (0.00264e0 * sin(a4) + 0.000063e0 * sin(2 * a4)) * {s}", f"-xp * {s}", f"-yp * {s}"]
    text = f"select *, {', '.join(f'{t} as t{k}' for k, t in enumerate(turns))} from ({text})"
    p = {"x": "px", "y": "py", "z": "pz"}
    for k, axis in enumerate(O.AXES):
        a, b = {1: ("y", "z"), 2: ("z", "x"), 3: ("x", "y")}[axis]
        new = {a: f"cos(t{k}) * {p[a]} + sin(t{k}) * {p[b]}", b: f"cos(t{k}) * {p[b]} - sin(t{k}) * {p[a]}"}
        text = f"select *, {', '.join(f'{e} as p{k}{c}' for c, e in new.items())} from ({text})"
        p |= {c: f"p{k}{c}" for c in new}
    return f"""with e as (select event_id, 55000 + cast(event_id * 7 % 6000 as double) + user_id % 24 / 24.0e0 as mjd, 7000000.0e0 + user_id * 1000 as px, event_id % 90 * 100000.0e0 as py, -3000000.0e0 + event_id % 61 * 100000 as pz from events),
d as (select *, cast(floor(mjd) as bigint) as k, mjd - floor(mjd) as f, case when mjd >= 57754 then 37 when mjd >= 57204 then 36 when mjd >= 56109 then 35 else 34 end as tai from e),
r as (select event_id, mjd, px, py, pz, tai, 0.1e0 * ((k % 400) / 400.0e0 * (1 - f) + ((k + 1) % 400) / 400.0e0 * f) as xp, 0.3e0 - 0.1e0 * ((k % 435) / 435.0e0 * (1 - f) + ((k + 1) % 435) / 435.0e0 * f) as yp, -30 - (k + f - 55000) / 1000.0e0 + tai as ut1 from d)
select event_id, round({p['x']}, 1) + 0.0 as xt, round({p['y']}, 1) + 0.0 as yt, round({p['z']}, 1) + 0.0 as zt from ({text})"""


@query(orientation_sql())
def celestial_to_terrestrial(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (55000 + F.col("event_id") * 7 % 6000 + F.col("user_id") % 24 / 24.0).alias("mjd"), (7e6 + F.col("user_id") * 1000.0).alias("x"), (F.col("event_id") % 90 * 1e5).alias("y"), (-3e6 + F.col("event_id") % 61 * 1e5).alias("z"))
    k = F.col("id") + 55000
    daily = spark.range(6002).select(k.cast("double").alias("mjd"), (0.1 * (k % 400) / 400.0).alias("xp_s"), (0.3 - 0.1 * (k % 435) / 435.0).alias("yp_s"), (-30 - F.col("id") / 1000.0 + O.N.leap_seconds(k)).alias("ut1_utc_s"))
    found = O.to_terrestrial(O.with_orientation(e, daily))
    return found.select("event_id", *[rounded(c, c, 1) for c in ("xt", "yt", "zt")])
