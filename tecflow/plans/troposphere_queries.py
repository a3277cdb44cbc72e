"""Mapping and weather at users' places, with coefficients by a rule in place of a published table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import troposphere as Z
from .registry import query, rounded, table

DEGREE = 9


def rule(which: int, n: int, m: int) -> float:
    """Coefficients that fall off with degree as those of models do."""
    return round(math.sin(which + 1.7 * n + 0.6 * m) * 10 / (1 + n) / math.prod(range(n - m + 1, n + m + 1)), 12)


def surface(which: int, level: float = 0.0) -> Z.Surface:
    places = [(n, m) for n in range(DEGREE + 1) for m in range(n + 1)]
    return Z.Surface({p: rule(which, *p) + (level if p == (0, 0) else 0.0) for p in places}, {p: rule(which + 1, *p) for p in places})


#: (first coefficients of the mean, its level, of the amplitude) of each model.
MODELS = {"dry": (0, 125.0, 2), "wet": (4, 56.0, 6), "pressure": (8, 1010.0, 10), "temperature": (12, 15.0, 14)}


def harmonics_sql() -> str:
    """Functions of degree and order by the usual recursion, degree by degree, and their sums."""
    text = """select user_id, radians(user_id % 18 * 10 - 85) as lat, radians(user_id * 23 % 360) as lon, 60000 + cast(user_id % 365 as double) as mjd, user_id % 40 * 50.0e0 as height from (select distinct user_id from events)"""
    text = f"select *, cos(lat) * cos(lon) as x, cos(lat) * sin(lon) as y, sin(lat) as z, 1.0e0 as v0_0, 0.0e0 as w0_0 from ({text})"
    for n in range(1, DEGREE + 1):
        new = []
        for c in "vw":
            for m in range(n):
                low = f" - {n + m - 1} * {c}{n - 2}_{m}" if n - 2 >= m else ""
                new.append(f"({2 * n - 1} * z * {c}{n - 1}_{m}{low}) / {n - m} as {c}{n}_{m}")
        new.append(f"{2 * n - 1} * (x * v{n - 1}_{n - 1} - y * w{n - 1}_{n - 1}) as v{n}_{n}")
        new.append(f"{2 * n - 1} * (x * w{n - 1}_{n - 1} + y * v{n - 1}_{n - 1}) as w{n}_{n}")
        text = f"select *, {', '.join(new)} from ({text})"
    number = lambda x: repr(x) if "e" in repr(x) else f"{x!r}e0"
    whole = lambda s: " + ".join(f"({number(s.a[p])}) * v{p[0]}_{p[1]} + ({number(s.b[p])}) * w{p[0]}_{p[1]}" for p in s.a)
    sums = ", ".join(f"({whole(surface(a, level))}) + ({whole(surface(b))}) * cos((mjd - 44266) / 365.25 * 2 * pi()) as {name}" for name, (a, level, b) in MODELS.items())
    return f"""with s as (select *, {sums} from ({text})),
c as (select *, 0.062e0 + case when lat < 0 then (cos((mjd - 44266) / 365.25 * 2 * pi() + pi()) + 1) * 0.0035e0 + 0.002e0 else (cos((mjd - 44266) / 365.25 * 2 * pi()) + 1) * 0.0025e0 + 0.001e0 end * (1 - cos(lat)) as dc, radians(5 + user_id % 80) as el from s),
f as (select *, dry * 1e-5 as a, (1 + dry * 1e-5 / (1 + 0.0029e0 / (1 + dc))) / (sin(el) + dry * 1e-5 / (sin(el) + 0.0029e0 / (sin(el) + dc))) as df,
1 / sin(el) - (1 + 2.53e-5 / (1 + 5.49e-3 / (1 + 1.14e-3))) / (sin(el) + 2.53e-5 / (sin(el) + 5.49e-3 / (sin(el) + 1.14e-3))) as hf,
(1 + wet * 1e-5 / (1 + 0.00146e0 / (1 + 0.04391e0))) / (sin(el) + wet * 1e-5 / (sin(el) + 0.00146e0 / (sin(el) + 0.04391e0))) as wf from c)
select user_id, round(df + hf * height / 1000, 8) as dry_factor, round(wf, 8) as wet_factor, round(pressure * pow(1 - 2.26e-5 * height, 5.225e0), 6) as pressure_hpa, round(temperature - 6.5e-3 * height, 6) as temperature_c from f"""


@query(harmonics_sql())
def seasonal_troposphere(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id").distinct()
    days = days.select("user_id", F.radians((F.col("user_id") % 18 * 10 - 85).cast("double")).alias("lat"), F.radians((F.col("user_id") * 23 % 360).cast("double")).alias("lon"), (60000 + F.col("user_id") % 365).cast("double").alias("mjd"), (F.col("user_id") % 40 * 50.0).alias("height_m"))
    found = Z.site_days(days, {name: Z.Seasonal(surface(a, level), surface(b)) for name, (a, level, b) in MODELS.items()})
    el = F.radians((5 + F.col("user_id") % 80).cast("double"))
    return found.select("user_id", rounded(Z.dry_factor(el, F.col("dry_a"), F.col("dry_c"), F.col("height_m")), "dry_factor", 8), rounded(Z.wet_factor(el, F.col("wet_a")), "wet_factor", 8), rounded("pressure_hpa", "pressure_hpa"), rounded("temperature_c", "temperature_c"))


@query("""with e as (select user_id, min(event_id) as k from events group by user_id),
s as (select user_id, k * 13 % 18000 / 100.0e0 - 90 as lat, k * 29 % 36000 / 100.0e0 as lon from e),
i as (select *, least(floor((90 - lat) / 10), 17) as i, floor(lon / 10) as j from s),
w as (select *, (90 - lat) / 10 - i as u, lon / 10 - j as v from i),
v as (select user_id, u, v, [1000 + i * i - j * 3, 1000 + i * i - ((j + 1) % 36) * 3, 1000 + (i + 1) * (i + 1) - j * 3, 1000 + (i + 1) * (i + 1) - ((j + 1) % 36) * 3] as a from w)
select user_id, round((1 - u) * ((1 - v) * a[1] + v * a[2]) + u * ((1 - v) * a[3] + v * a[4]), 6) as ah from v""")
def gridded_mapping(spark, sf_dir):
    """Values between grid nodes, across the date line and at both poles."""
    sites = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("k")).select("user_id", F.lit("one").alias("epoch"), (F.col("k") * 13 % 18000 / 100.0 - 90).alias("lat"), (F.col("k") * 29 % 36000 / 100.0).alias("lon"))
    node = spark.range(19 * 36).select(F.floor(F.col("id") / 36).alias("r"), (F.col("id") % 36).alias("c"))
    grid = node.select(F.lit("one").alias("epoch"), (90.0 - F.col("r") * 10).alias("lat"), (F.col("c") * 10.0).alias("lon"), (1000.0 + F.col("r") * F.col("r") - F.col("c") * 3).alias("ah"))
    return Z.gridded(sites, grid, ["ah"], 90.0, 10.0, 0.0, 10.0).select("user_id", rounded("ah", "ah"))
