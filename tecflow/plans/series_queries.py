"""Series operators on the events table: a user is a satellite, its events are epochs, value is the measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import series as S
from .registry import query, rounded, table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
W = "partition by user_id order by ts, event_id"
VALID = "event_type <> 'error'"

#: Arcs of events, for the SQL of all operators that work inside arcs.
ARCS = f"""
flagged as (select *, coalesce({VALID}, false) v, coalesce(lag({VALID}) over ({W}), false) pv from events),
arcs as (select *, case when v then sum(case when v and not pv then 1 else 0 end) over ({W} rows unbounded preceding) end arc from flagged)"""
A = "partition by user_id, arc order by ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def with_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arcs(events(spark, sf_dir), KEYS, ORDER, F.col("event_type") != "error")


def shown(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    return df.select("event_id", rounded(name, "result", digits))


@query(f"select event_id, round(lead(value) over ({W}) - value, 6) + 0.0 as result from events")
def rot_forward(spark, sf_dir):
    return shown(S.forward_difference(events(spark, sf_dir), KEYS, ORDER, "value"), "diff")


@query(f"""select event_id, round(case when value <> 0 and lag(value) over ({W}) <> 0 then value - lag(value) over ({W}) end, 6) + 0.0 as result from events""")
def rot_backward(spark, sf_dir):
    return shown(S.backward_difference(events(spark, sf_dir), KEYS, ORDER, "value"), "diff")


SLIDING = """with s as (select *, case when row_number() over w >= 10 and count(value) over f >= {least} then {f}(value) over f end d from events
window w as (partition by user_id order by ts, event_id), f as (partition by user_id order by ts, event_id rows between 9 preceding and current row))
select event_id, round(lead(d, {shift}) over (partition by user_id order by ts, event_id), 6) + 0.0 as result from s"""


@query(SLIDING.format(least=2, f="stddev_samp", shift=5))
def roti_window(spark, sf_dir):
    return shown(S.sliding_deviation(events(spark, sf_dir), KEYS, ORDER, "value"), "deviation")


@query(SLIDING.format(least=10, f="stddev_pop", shift=0))
def roti_strict(spark, sf_dir):
    return shown(S.sliding_deviation(events(spark, sf_dir), KEYS, ORDER, "value", ddof=0, least=10, shift=0), "deviation")


@query(SLIDING.format(least=2, f="stddev_pop", shift=1))
def sigma_window(spark, sf_dir):
    return shown(S.sliding_deviation(events(spark, sf_dir), KEYS, ORDER, "value", ddof=0, shift=1), "deviation")


@query("""with s as (select *, case when count(value) over f = 10 and sum(value) over f > 0 then value / avg(value) over f end x from events
window f as (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding))
select event_id, round(case when count(x) over g = 10 then sqrt(greatest(avg(x * x) over g - avg(x) over g * avg(x) over g, 0.0)) / avg(x) over g end, 6) + 0.0 as result from s
window g as (partition by user_id order by ts, event_id rows between 9 preceding and current row)""")
def s4c(spark, sf_dir):
    return shown(S.variation_index(events(spark, sf_dir), KEYS, ORDER, "value"), "s4c")


@query(f"with {ARCS} select event_id, cast(coalesce(arc, 0) as bigint) as arc from arcs")
def arc_islands(spark, sf_dir):
    return with_arcs(spark, sf_dir).select("event_id", F.coalesce("arc", F.lit(0)).cast("long").alias("arc"))


@query(f"with {ARCS} select event_id, round(case when arc is not null and count(*) over (partition by user_id, arc) >= 4 then value end, 6) + 0.0 as result from arcs")
def short_arcs(spark, sf_dir):
    return shown(S.without_short_arcs(with_arcs(spark, sf_dir), KEYS, "value", 4), "value")


@query(f"""with {ARCS} select event_id, round(case when arc is not null and row_number() over ({A}) > 1 and row_number() over ({A}) <= count(*) over (partition by user_id, arc) - 1 then value end, 6) + 0.0 as result from arcs""")
def arc_edges(spark, sf_dir):
    return shown(S.without_arc_ends(with_arcs(spark, sf_dir), KEYS, ORDER, "value", 1), "value")


@query(f"""with {ARCS}, j as (select *, case when abs(value - lag(value) over ({A})) > 250 then 1 else 0 end j from arcs),
b as (select *, max(j) over ({A} rows unbounded preceding) b from j),
n as (select *, sum(case when arc is not null and b = 0 and value is not null then 1 else 0 end) over (partition by user_id, arc) n from b)
select event_id, round(case when arc is not null and b = 0 and n >= 3 then value end, 6) + 0.0 as result from n""")
def anomaly_clean(spark, sf_dir):
    return shown(S.without_anomalies(with_arcs(spark, sf_dir), KEYS, ORDER, "value", 250.0, 3), "value")


SLIP = f"""{ARCS}, lanes as (select *, value / 1000 as gf, round(value / 50, 3) as mw from arcs),
seen as (select *, abs(gf - lag(gf) over ({A})) > 4 * {S.SLIP_NOISE!r} * (1 + 10 * exp(-45.0 / 10)) + {S.SLIP_DRIFT!r} as leap,
count(mw) over (p rows between 30 preceding and 1 preceding) as c, avg(mw) over (p rows between 30 preceding and 1 preceding) as m,
greatest(coalesce(stddev_samp(mw) over (p rows between 30 preceding and 1 preceding), 0), 0.01) as sd, stddev_samp(mw) over (partition by user_id, arc) as whole
from lanes window p as ({A})),
slips as (select *, arc is not null and (coalesce(leap, false) or coalesce(c >= 3 and abs(mw - m) > 5 * sd and whole > 0.6, false)) as slip from seen)"""


def with_slips(spark, sf_dir):
    df = with_arcs(spark, sf_dir).withColumn("gf", F.col("value") / 1000).withColumn("mw", F.round(F.col("value") / 50, 3))
    return S.slips(df, KEYS, ORDER, "gf", "mw", F.lit(45.0))


@query(f"with {SLIP} select event_id, slip from slips")
def slip_detect(spark, sf_dir):
    return with_slips(spark, sf_dir).select("event_id", "slip")


@query(f"""with {SLIP}, c as (select *, gf - lag(gf) over ({A}) as jump, round_even(mw - lag(mw) over ({A}), 0) as lane from slips),
d as (select *, round_even((jump - 0.24421 * lane) / (0.19029 - 0.24421), 0) as n from c)
select event_id, round(gf - sum(case when slip then coalesce(n * 0.19029 - (n - lane) * 0.24421, 0) else 0 end) over ({A} rows unbounded preceding), 6) + 0.0 as result from d""")
def slip_repair(spark, sf_dir):
    return shown(S.repaired(with_slips(spark, sf_dir), KEYS, ORDER, "gf", "mw", "slip", (0.19029, 0.24421)), "repaired")


@query(f"""with {SLIP} select event_id, round(gf - sum(case when slip then coalesce(j, 0) else 0 end) over ({A} rows unbounded preceding), 6) + 0.0 as result from (select *, gf - lag(gf) over ({A}) as j from slips)""")
def slip_repair_simple(spark, sf_dir):
    return shown(S.repaired(with_slips(spark, sf_dir), KEYS, ORDER, "gf", None, "slip", (0.19029, 0.24421)), "repaired")


@query(f"select event_id, round(case when coalesce(abs(value - lag(value) over ({W})) > 200, false) then null else value end, 6) + 0.0 as result from events")
def slip_mask(spark, sf_dir):
    return shown(S.without_jumps(events(spark, sf_dir), KEYS, ORDER, "value", 200.0), "value")


PHASE = "(value * 0.5 + event_id % 7)"


def coded(spark, sf_dir):
    return with_arcs(spark, sf_dir).withColumn("phase", F.col("value") * 0.5 + F.col("event_id") % 7)


@query(f"""with {ARCS} select event_id, round(case when arc is not null and row_number() over ({A}) > 2 then avg(value + {PHASE}) over ({A} rows unbounded preceding) - {PHASE} end, 6) + 0.0 as result from arcs""")
def hatch(spark, sf_dir):
    return shown(S.smoothed(coded(spark, sf_dir), KEYS, ORDER, "value", "phase", warm=2), "smoothed")


@query(f"with {ARCS} select event_id, round(case when arc is not null then avg(value + {PHASE}) over (partition by user_id, arc) - {PHASE} end, 6) + 0.0 as result from arcs")
def arc_mean(spark, sf_dir):
    return shown(S.levelled(coded(spark, sf_dir), KEYS, "value", "phase"), "levelled")


@query(f"""with a as (select *, value / 490.0 * 6 - 3 as angle from events), t as (select *, floor((lag(angle, 1, 0.0) over ({W}) - angle) / (2 * 3.141592653589793) + 0.5) as t from a)
select event_id, round(angle + 2 * 3.141592653589793 * sum(t) over ({W} rows unbounded preceding), 6) + 0.0 as result from t""")
def unwrap(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("angle", F.col("value") / 490.0 * 6 - 3)
    return shown(S.unwrapped(df, KEYS, ORDER, "angle"), "unwrapped")


@query("""with d as (select *, hour(ts) * 60 + minute(ts) as epoch from events), o as (select event_type, epoch, user_id % 5 as sat, avg(value) as v from d group by all),
j as (select *, v - lag(v) over (partition by event_type, sat order by epoch) as d from o),
c as (select event_type, epoch, round_even(avg(d) / 50, 0) as whole, min(d) as lo, max(d) as hi from j group by all),
s as (select event_type, epoch, sum(case when whole <> 0 and abs(lo / 50 - whole) <= 0.25 and abs(hi / 50 - whole) <= 0.25 then whole * 50 else 0 end) over (partition by event_type order by epoch rows unbounded preceding) as s from c)
select event_type, cast(epoch as bigint) as epoch, cast(sat as bigint) as sat, round(v - s, 6) + 0.0 as result from j join s using (event_type, epoch)""")
def clock_jump(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("epoch", (F.hour("ts") * 60 + F.minute("ts")).cast("long")).withColumn("sat", F.col("user_id") % 5)
    df = df.groupBy("event_type", "epoch", "sat").agg(F.avg("value").alias("v"))
    return S.clock_repaired(df, ["event_type"], "epoch", ["sat"], "v", 50.0, 0.25).select("event_type", "epoch", "sat", rounded("repaired", "result"))


@query(f"select event_id from (select *, epoch(ts) - lag(epoch(ts)) over ({W}) as g from events) where g is null or g > 3600")
def time_dedupe(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return S.spaced(events(spark, sf_dir), KEYS, ORDER, seconds, 3600.0).select("event_id")


@query("select user_id, event_type, min_by(event_id, row(ts, event_id)) as event_id from events group by all")
def first_write(spark, sf_dir):
    return S.first_written(events(spark, sf_dir), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query(f"""with r as (select *, row_number() over ({W}) - 1 as i from events), l as (select user_id, regr_slope(value, i) as s, regr_intercept(value, i) as b from r group by all)
select event_id, round(value - (b + s * i), 6) + 0.0 as result from r join l using (user_id)""")
def detrend_linear(spark, sf_dir):
    return shown(S.detrended(events(spark, sf_dir), KEYS, ORDER, "value"), "detrended")


@query(f"""with t as (select *, case when sqrt(pow(value - lag(value) over ({W}), 2) + pow(event_id % 100 - lag(event_id % 100) over ({W}), 2)) > 300 then 1 else 0 end as n from events)
select event_id, cast(sum(n) over ({W} rows unbounded preceding) as bigint) as track from t""")
def track_split(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("y", F.col("event_id") % 100)
    return S.split_at_jumps(df, KEYS, ORDER, ["value", "y"], 300.0).select("event_id", "track")


@query("select event_id, case when abs(value) <= 400 then value end as result from events")
def absolute_caps(spark, sf_dir):
    return S.capped(events(spark, sf_dir), "value", 400.0).select("event_id", F.col("value").alias("result"))


@query("""with e as (select user_id, cast(ts as date) - date '2024-01-01' as day, sum(value) as v from events group by all),
a as (select user_id, unnest(range(30)) as day from (select distinct user_id from events))
select a.user_id, cast(a.day as bigint) as day, round(v, 6) + 0.0 as result from a left join e on a.user_id = e.user_id and a.day = e.day""")
def dense_epochs(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum("value").alias("v"))
    return S.dense(days, KEYS, "day", 0, 29).select("user_id", F.col("day").cast("long").alias("day"), rounded("v", "result"))


@query(f"""with d as (select *, 2 * (lead(value) over ({W}) - value) as rot from events),
s as (select *, case when row_number() over w >= 10 and count(rot) over f >= 2 then stddev_samp(rot) over f end as sd from d
window w as ({W}), f as ({W} rows between 9 preceding and current row)),
x as (select *, lead(sd, 5) over ({W}) as roti from s),
v as (select *, coalesce(roti is not null, false) as v, coalesce(lag(roti is not null) over ({W}), false) as pv from x),
a as (select *, case when v then sum(case when v and not pv then 1 else 0 end) over ({W} rows unbounded preceding) end as arc from v),
j as (select *, case when abs(roti - lag(roti) over (partition by user_id, arc order by ts, event_id)) > 100 then 1 else 0 end as j from a),
b as (select *, max(j) over (partition by user_id, arc order by ts, event_id rows unbounded preceding) as b from j),
n as (select *, sum(case when arc is not null and b = 0 then 1 else 0 end) over (partition by user_id, arc) as n from b)
select event_id, round(case when arc is not null and b = 0 and n >= 10 and abs(roti) <= 500 then roti end, 6) + 0.0 as result from n""")
def roti_chain(spark, sf_dir):
    """The whole rate-of-change index: difference, rate, sliding deviation, anomaly cleaning, cap. One exchange serves all windows by user."""
    df = S.forward_difference(events(spark, sf_dir), KEYS, ORDER, "value").withColumn("rot", 2 * F.col("diff"))
    df = S.sliding_deviation(df, KEYS, ORDER, "rot", out="roti")
    df = S.arcs(df, KEYS, ORDER, F.col("roti").isNotNull())
    return shown(S.capped(S.without_anomalies(df, KEYS, ORDER, "roti", 100.0, 10), "roti", 500.0), "roti")


F3 = (1575.42e6, 1227.60e6, 1176.45e6)
LANES = {k: repr(v).replace("e+", "e") for k, v in {"w1": 299792458.0 / F3[0], "w2": 299792458.0 / F3[1], "w3": 299792458.0 / F3[2]}.items()}
#: Phases and codes of three carriers from an event: slips where its number divides by 9, noise that both engines see.
THREE = {
    "n1": "floor(value) % 5 * case when event_id % 9 = 0 then 1 else 0 end", "n2": "floor(value / 3) % 4 * case when event_id % 9 = 0 then 1 else 0 end", "n3": "floor(value / 7) % 3 * case when event_id % 9 = 0 then 1 else 0 end",
    "base": "20000.0e0 + event_id % 97", "delay": "0.002e0 * (event_id % 5)", "noise": "0.02e0 * (event_id % 11 - 5)",
}


def three_sql() -> str:
    a, b, c = F3
    light = 299792458.0
    lane = lambda i, j: f"(({F3[i]} * l{i + 1} - {F3[j]} * l{j + 1}) / {F3[i] - F3[j]} - ({F3[i]} * c{i + 1} + {F3[j]} * c{j + 1}) / {F3[i] + F3[j]}) * {(F3[i] - F3[j]) / light!r}"
    given = ", ".join(f"{text} as {name}" for name, text in THREE.items())
    sums = ", ".join(f"sum(n{k}) over ({W} rows unbounded preceding) as s{k}" for k in (1, 2, 3))
    return f"""with e as (select event_id, user_id, ts, cast(value as double) as value from events), g as (select *, {given} from e), s as (select *, {sums} from g),
o as (select *, base - delay + {LANES['w1']} * s1 as l1, base - delay * {(a / b) ** 2!r} + {LANES['w2']} * s2 as l2, base - delay * {(a / c) ** 2!r} + {LANES['w3']} * s3 as l3,
base + delay + noise as c1, base + delay * {(a / b) ** 2!r} - noise as c2, base + delay * {(a / c) ** 2!r} + noise / 2 as c3 from s),
k as (select *, {lane(0, 1)} as la, {lane(1, 2)} as lb, l1 - l2 as lg, l1 - l3 as lh from o),
d as (select *, la - lag(la) over ({W}) as a, lb - lag(lb) over ({W}) as b, lg - lag(lg) over ({W}) as g, lh - lag(lh) over ({W}) as h from k),
t as (select d.*, round_even(a, 0) + x as na, round_even(b, 0) + y as nb from d, range(-1, 2) as p(x), range(-1, 2) as q(y) where a is not null),
u as (select *, round_even((g - {LANES['w2']} * na) / ({LANES['w1']} - {LANES['w2']}), 0) as m from t),
v as (select *, pow((a - na) / 0.25e0, 2) + pow((b - nb) / 0.25e0, 2) + pow((g - {LANES['w1']} * m + {LANES['w2']} * (m - na)) / 0.01e0, 2) + pow((h - {LANES['w1']} * m + {LANES['w3']} * (m - na - nb)) / 0.01e0, 2) as cost from u),
m as (select event_id, min(struct_pack(cost := cost, m := m, na := na, nb := nb)) as best from v group by event_id)
select event_id, coalesce(best.cost > 16, false) as cut, cast(case when best.cost <= 16 then best.m else 0 end as bigint) as slip1, cast(case when best.cost <= 16 then best.m - best.na else 0 end as bigint) as slip2,
cast(case when best.cost <= 16 then best.m - best.na - best.nb else 0 end as bigint) as slip3 from e left join m using (event_id)"""


@query(three_sql())
def slip_three(spark, sf_dir):
    """Slips on three carriers by the search over whole numbers."""
    e = events(spark, sf_dir).withColumn("value", F.col("value").cast("double")).withColumns({name: F.expr(text).cast("double") for name, text in THREE.items()})
    w, so_far = [299792458.0 / f for f in F3], S.running(KEYS, ORDER)
    e = e.withColumns({f"s{k}": F.sum(f"n{k}").over(so_far) for k in (1, 2, 3)})
    slow = [1.0, (F3[0] / F3[1]) ** 2, (F3[0] / F3[2]) ** 2]
    e = e.withColumns({f"l{k + 1}": F.col("base") - F.col("delay") * slow[k] + w[k] * F.col(f"s{k + 1}") for k in range(3)})
    e = e.withColumns({f"c{k + 1}": F.col("base") + F.col("delay") * slow[k] + F.col("noise") * (1.0, -1.0, 0.5)[k] for k in range(3)})
    return S.slips_of_three(e, KEYS, ORDER, ["l1", "l2", "l3"], ["c1", "c2", "c3"], F3).select("event_id", "cut", "slip1", "slip2", "slip3")
