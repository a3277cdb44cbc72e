"""Joins, set operations and limits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G
from ..operators import joins as J, series as S
from .registry import query, rounded, table

DAY = "strftime(ts, '%Y-%m-%d')"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query("select s_suppkey, r_name, strftime(d, '%Y-%m-%d') as day from supplier, region, (select unnest(generate_series(date '2024-01-01', date '2024-01-05', interval 1 day)) as d)")
def expand_subtasks(spark, sf_dir):
    s, r = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "region").select("r_name")
    days = [F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-05")]
    return J.expanded(s, r, *days).select("s_suppkey", "r_name", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(f"""with u as (select distinct user_id from events), d as (select distinct {DAY} as day from events) select user_id, day from u, d where not exists (select 1 from events e where e.user_id = u.user_id and {DAY} = day)""")
def missing_pairs(spark, sf_dir):
    there = day(events(spark, sf_dir)).select("user_id", "day").distinct()
    return J.missing(there.select("user_id").distinct().crossJoin(there.select("day").distinct()), there, ["user_id", "day"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_labels(spark, sf_dir):
    return J.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def known_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query(f"""with d as (select event_type, {DAY} as day, max(case when event_id % 3 = 0 then event_id end) as p from events group by all)
select event_type, day, coalesce(last_value(p ignore nulls) over (b rows between unbounded preceding and 1 preceding), -1) as previous, coalesce(p, -1) as same,
coalesce(first_value(p ignore nulls) over (b rows between 1 following and unbounded following), -1) as next from d window b as (partition by event_type order by day)""")
def asof_products(spark, sf_dir):
    d = day(events(spark, sf_dir)).groupBy("event_type", "day").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("p"))
    return J.neighbours(d, ["event_type"], "day", "p").select("event_type", "day", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous", "same", "next")])


@query("""select a.event_id, coalesce((select max_by(b.event_id, b.ts) from events b where b.user_id = a.user_id and b.event_type = 'error' and b.ts <= a.ts), -1) as last_error from events a where a.event_type <> 'error'""")
def asof_last(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("last_error"))
    left = e.where("event_type <> 'error'").select("event_id", "user_id", "ts")
    return J.at_or_before(left, right, ["user_id"], "ts", ["last_error"]).select("event_id", F.coalesce("last_error", F.lit(-1)).alias("last_error"))


@query(f"""with p as (select distinct case when event_id % 50 = 0 then {DAY} end as d from events where event_id % 25 = 0 and event_id % 50 = 0) select event_id from events where exists (select 1 from p where d is null or d = {DAY})""")
def theta_match(spark, sf_dir):
    e = day(events(spark, sf_dir))
    products = e.where("event_id % 50 = 0").select(F.col("day").alias("product_day"))
    return J.matching_or_any(e, products, "day", "product_day").select("event_id")


@query("""with o as (select user_id, event_type, max(value) as top from events where event_id % 2 = 0 group by all)
select e.event_id, round(coalesce(top, -1), 6) as top from events e left join o on e.user_id = o.user_id and e.event_type = o.event_type""")
def equi_left(spark, sf_dir):
    e = events(spark, sf_dir)
    top = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return e.select("event_id", "user_id", "event_type").join(top, ["user_id", "event_type"], "left").select("event_id", F.round(F.coalesce("top", F.lit(-1.0)), 6).alias("top"))


def lagrange_sql() -> str:
    offsets = range(-4, 6)
    terms = []
    for j in offsets:
        weight = " * ".join(f"(p - {m}) / {float(j - m)!r}e0" for m in offsets if m != j)
        terms.append(f"{weight} * sin((k + {j}) * 900 / 5000.0e0) * 2e7")
    return f"""with t as (select event_id, event_id * 83 % 86400 as s from events), a as (select event_id, floor(s / 900) as k, s / 900 - floor(s / 900) as p from t)
select event_id, case when k >= 4 then round({' + '.join(terms)}, 3) + 0.0 end as x from a"""


@query(lagrange_sql())
def knn_lagrange(spark, sf_dir):
    """Ten-point interpolation of an orbit: targets meet the row of their anchor's number; before the fifth anchor there is no value."""
    t = events(spark, sf_dir).select("event_id", F.lit("G01").alias("sat"), (F.col("event_id") * 83 % 86400).alias("s"))
    anchors = spark.range(0, 101).select(F.lit("G01").alias("sat"), (F.col("id") * 900).alias("s"), (F.sin(F.col("id") * 900 / 5000.0) * 2e7).alias("x"))
    return J.interpolated(t, anchors, ["sat"], "s", 900.0, ["x"]).select("event_id", rounded("x", "x", 3))


@query("""with a as (select user_id, ts, value as v from events where event_id % 4 = 0), t as (select event_id, user_id, ts from events where event_id % 4 <> 0),
n as (select t.event_id, t.ts, max_by(struct_pack(t := epoch(b.ts), v := b.v), b.ts) filter (b.ts <= t.ts) as b, min_by(struct_pack(t := epoch(b.ts), v := b.v), b.ts) filter (b.ts > t.ts) as a from t left join a b on b.user_id = t.user_id group by all)
select event_id, round(b.v + (a.v - b.v) * (epoch(ts) - b.t) / (a.t - b.t), 4) + 0.0 as v from n""")
def clock_interp(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    anchors = e.where("event_id % 4 = 0").select("user_id", "t", F.col("value").alias("v"))
    return J.bracketed(e.where("event_id % 4 <> 0").select("event_id", "user_id", "t"), anchors, ["user_id"], "t", "v", 86400.0).select("event_id", rounded("v", "v", 4))


@query("""with s as (select user_id as k, avg(value) as ns from events where user_id % 3 = 0 group by all), r as (select event_type as k, avg(value) as ns from events where event_type < 'm' group by all)
select event_id, round(value - 299792458.0e0 * 1e-9 * (coalesce(s.ns, 0) + coalesce(r.ns, 0)), 5) + 0.0 as corrected from events left join s on s.k = user_id left join r on r.k = event_type""")
def bias_lookup(spark, sf_dir):
    from ..functions import signal as X

    e = events(spark, sf_dir)
    sat = e.where("user_id % 3 = 0").groupBy("user_id").agg(F.avg("value").alias("ns"))
    rec = e.where("event_type < 'm'").groupBy("event_type").agg(F.avg("value").alias("ns"))
    both = J.biases(e, sat, rec, ["user_id"], ["event_type"])
    return both.select("event_id", rounded(X.bias_corrected(F.col("value"), F.col("satellite_ns"), F.col("receiver_ns")), "corrected", 5))


@query("select c_custkey from customer where upper(substring(c_name, 1, 4)) in (select upper(substring(s_name, 1, 4)) from supplier union all select 'CUST')")
def prefix_semi(spark, sf_dir):
    codes = table(spark, sf_dir, "supplier").select("s_name").union(spark.range(1).select(F.lit("Customer")))
    return J.of_prefix(table(spark, sf_dir, "customer"), codes, "c_name", "s_name").select("c_custkey")


@query("""with n as (select n_name, cast(n_nationkey as varchar) as k from nation), r as (select event_id, case when event_id % 2 = 0 then cast(event_id % 30 as varchar) else (select min(n_name) from nation) end as key from events)
select event_id, coalesce(a.n_name, b.n_name, '') as found from r left join n a on a.k = key left join n b on b.n_name = key""")
def either_key(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_name").alias("found"))
    name = n.agg(F.min("n_name")).first()[0]
    r = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 30).cast("string")).otherwise(name).alias("key"))
    return J.by_either(r, n, "key", "k", "n_name", ["found"]).select("event_id", F.coalesce("found", F.lit("")).alias("found"))


PAIRS = """o as (select s_suppkey % 6 as station, l_partkey as sat, cast(l_linenumber as bigint) as epoch, avg(l_extendedprice) / 100 as crot, avg(s_suppkey * 13 % 40) as lat, avg(s_suppkey * 29 % 60) as lon from lineitem join supplier on l_suppkey = s_suppkey group by all),
p as (select a.station as sa, b.station as sb, a.sat, a.epoch, abs(a.crot - b.crot) as d, a.lat as la, a.lon as oa, b.lat as lb, b.lon as ob from o a join o b on a.sat = b.sat and a.epoch = b.epoch and a.station < b.station),
k as (select *, 2 * 6371.0e0 * asin(sqrt(least(pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin((radians(ob) - radians(oa)) / 2), 2), 1.0))) as km from p),
c as (select *, case when km <= 1000 then (case when pow(d / 50, 3) * (1000 / km) >= 1 then 1 else 0 end) + (case when pow(d / 100, 3) * (1000 / km) >= 1 then 1 else 0 end) + (case when pow(d / 200, 3) * (1000 / km) >= 1 then 1 else 0 end) else 0 end as n,
cast(floor((la + lb) / 2 / 5) as bigint) as i, cast(floor((oa + ob) / 2 / 5) as bigint) as j from k where km > 0), m as (select epoch, sa, sb, i, j, max(n) as m from c group by all)"""


def gradient_cells(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    obs = li.groupBy((F.col("s_suppkey") % 6).alias("station"), F.col("l_partkey").alias("sat"), F.col("l_linenumber").cast("long").alias("epoch")).agg((F.avg("l_extendedprice") / 100).alias("crot"), F.avg(F.col("s_suppkey") * 13 % 40).alias("lat"), F.avg(F.col("s_suppkey") * 29 % 60).alias("lon"))
    p = J.station_pairs(obs, "station", ["sat", "epoch"], ["crot", "lat", "lon"])
    km = G.great_circle(*[F.radians(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")], G.EARTH_KM)
    p = p.withColumn("km", km).where("km > 0").withColumn("n", J.gradient_counts(F.col("crot_a") - F.col("crot_b"), F.col("km"), (50.0, 100.0, 200.0)))
    lat, lon = G.midpoint_deg(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return p.withColumn("i", G.cell_lower(lat, 0, 5).cast("long")).withColumn("j", G.cell_lower(lon, 0, 5).cast("long"))


@query(f"with {PAIRS} select epoch, round(sum(m) / count(m), 6) as index from m group by all")
def pair_gradient(spark, sf_dir):
    return J.gradient_index(gradient_cells(spark, sf_dir), ["epoch"], ["station_a", "station_b"], ["i", "j"], "n")[0].select("epoch", F.round("index", 6).alias("index"))


@query(f"with {PAIRS} select epoch, i, j, cast(max(m) as bigint) as value from m group by all")
def gradient_map(spark, sf_dir):
    return J.gradient_index(gradient_cells(spark, sf_dir), ["epoch"], ["station_a", "station_b"], ["i", "j"], "n")[1].select("epoch", "i", "j", F.col("value").cast("long").alias("value"))


@query("""select event_id, user_id, round(value, 4) as value from (select event_id, user_id, value from events where event_id % 10 <> 0 union all select event_id, user_id, value + 1 from events where event_id % 10 = 0)""")
def upsert(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "value")
    new = e.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1)
    return J.replaced(e, new, ["event_id"]).select("event_id", "user_id", F.round("value", 4).alias("value"))


@query("select event_id, user_id from events where event_id % 3 = 0 and user_id not in (select user_id from events where value > 489)")
def cascade_delete(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_id % 3 = 0").join(e.where("value > 489").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


@query("select event_id, value from events order by value desc, event_id limit 100")
def top_rows(spark, sf_dir):
    """The first hundred rows of a report."""
    return events(spark, sf_dir).select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("select l_suppkey, l_partkey from (select distinct l_suppkey, l_partkey, dense_rank() over (partition by l_suppkey order by l_partkey) as r from lineitem) where r <= 8")
def first_columns(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))).where("r <= 8").select("l_suppkey", "l_partkey")


@query("select user_id from events where event_type = 'error' except select user_id from events where value > 480")
def set_diff(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_type = 'error'").select("user_id").distinct().subtract(e.where("value > 480").select("user_id"))


@query("select user_id from events where event_type = 'error' intersect select user_id from events where value > 480")
def set_common(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("value > 480").select("user_id"))


@query("""select user_id, ts::varchar as ts, event_id from (select *, row_number() over (partition by user_id, ts order by event_id) as n from (select * from events where event_id % 3 <> 0 union all select * from events where event_id % 2 = 0)) where n = 1""")
def union_dedupe(spark, sf_dir):
    e = events(spark, sf_dir)
    both = e.where("event_id % 3 <> 0").unionByName(e.where("event_id % 2 = 0"))
    return S.first_written(both, ["user_id", "ts"], ["event_id"]).select("user_id", F.col("ts").cast("string").alias("ts"), "event_id")


@query("""select user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type) filter (value > 300), list(event_type) filter (event_id % 2 = 0)))), ',') as kinds from events group by all""")
def flag_union(spark, sf_dir):
    e = events(spark, sf_dir)
    high, even = (F.collect_set(F.when(c, F.col("event_type"))) for c in (F.col("value") > 300, F.col("event_id") % 2 == 0))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(high, even)), ",").alias("kinds"))
