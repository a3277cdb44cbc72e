"""Aggregations on events, line items and result statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregates as A
from .registry import query, rounded, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""with r as (select event_type, hour(ts) as h, 2 * (lead(value) over (partition by user_id order by ts, event_id) - value) as rot from events),
x as (select unnest(range(24)) as h), t as (select distinct event_type from r)
select t.event_type, cast(x.h as bigint) as hour, round(coalesce(sqrt(avg(rot * rot)), 0), 5) + 0.0 as rms from t cross join x left join r on r.event_type = t.event_type and r.h = x.h group by all""")
def rms_hourly(spark, sf_dir):
    """The hourly index: rate of change, then its root mean square by event type on a full axis of hours."""
    from ..operators import series as S

    rates = S.forward_difference(events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"], "value").withColumn("rot", 2 * F.col("diff"))
    return A.hourly_rms(rates, ["event_type"], F.hour("ts"), "rot").select("event_type", "hour", rounded("rms", "rms", 5))


@query("""with r as (select event_type, hour(ts) * 60 + minute(ts) + 1 as e, value / (1 + event_id % 3) as x from events)
select event_type, cast(floor((e - 1) / 90) as bigint) as block, round(sqrt(avg(x * x)), 5) + 0.0 as rms, count(x) as n from r group by all""")
def rms_block(spark, sf_dir):
    epoch = F.hour("ts") * 60 + F.minute("ts") + 1
    return A.block_rms(events(spark, sf_dir), ["event_type"], epoch, 90, "value", 1 + F.col("event_id") % 3).select("event_type", "block", rounded("rms", "rms", 5), "n")


STATS = "select user_id, event_type, min(v) as least, max(v) as most, avg(v) as mean, quantile_cont(v, 0.95) as p95, avg(case when v is null then 1.0 else 0.0 end) as missing, count_if(v > 400) as events from (select *, case when event_id % 7 <> 0 then value end as v from events) group by all"


def stats(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return A.statistics(df, ["user_id", "event_type"], "v", 400.0)


@query(f"select user_id, event_type, round(least, 6) as least, round(most, 6) as most, round(mean, 6) as mean, round(p95, 6) as p95, round(missing, 6) as missing, cast(events as bigint) as events from ({STATS})")
def result_stats(spark, sf_dir):
    """Values are rounded to nine digits first: a mean halfway between two of six digits goes up, whatever the last bit of its sum."""
    return stats(spark, sf_dir).select("user_id", "event_type", *[F.round(F.round(c, 9), 6).alias(c) for c in ("least", "most", "mean", "p95", "missing")], "events")


@query(f"select event_type, count(*) as results, round(min(least), 6) as least, round(max(most), 6) as most, round(avg(mean), 6) as mean, cast(sum(events) as bigint) as events, array_to_string(list_sort(list(distinct cast(user_id as varchar))), ',') as stations from ({STATS}) group by all")
def metric_rollup(spark, sf_dir):
    r = A.rollup(stats(spark, sf_dir), ["event_type"], "user_id")
    return r.select("event_type", "results", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean")], "events", "stations")


@query("""with a as (select event_id, value as v from events where event_id % 5 <> 0), b as (select event_id, value + event_id % 3 as v from events where event_id % 7 <> 0)
select count(*) as n, count_if(b.event_id is null)::bigint as left_only, count_if(a.event_id is null)::bigint as right_only, round(avg(abs(a.v - b.v)), 6) as mae, round(max(abs(a.v - b.v)), 6) as worst from a full join b using (event_id)""")
def diff_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_id % 5 <> 0").select("event_id", F.col("value").alias("v"))
    b = e.where("event_id % 7 <> 0").select("event_id", (F.col("value") + F.col("event_id") % 3).alias("v"))
    return A.difference_summary(a, b, ["event_id"], "v").select("n", "left_only", "right_only", F.round("mae", 6).alias("mae"), F.round("worst", 6).alias("worst"))


CELLS = "c as (select event_type, hour(ts) as h, cast(floor(value / 50) as bigint) as lat, cast(event_id % 20 as bigint) as lon, user_id, event_id, value from events)"


def cells(spark, sf_dir):
    return events(spark, sf_dir).select("event_type", F.hour("ts").cast("long").alias("h"), F.floor(F.col("value") / 50).cast("long").alias("lat"), (F.col("event_id") % 20).alias("lon"), "user_id", "event_id", "value")


@query(f"with {CELLS} select cast(h as bigint) as h, lat, lon, max(value) as cell_max from c group by all")
def grid_max(spark, sf_dir):
    return A.cell_max(cells(spark, sf_dir), ["h"], ["lat", "lon"], "value")


@query(f"with {CELLS} select lat, lon, round(avg(value), 6) as cell_mean, count(value) as n from c group by all")
def grid_mean(spark, sf_dir):
    return A.cell_mean(cells(spark, sf_dir), [], ["lat", "lon"], "value").select("lat", "lon", F.round("cell_mean", 6).alias("cell_mean"), "n")


@query(f"with {CELLS} select lat, lon, round(list_reduce(list(value order by event_id), lambda a, x: (a + x) / 2), 3) as cell_mean from c group by all")
def grid_running_mean(spark, sf_dir):
    return A.cell_running_mean(cells(spark, sf_dir), [], ["lat", "lon"], F.col("event_id"), "value").select("lat", "lon", F.round("cell_mean", 3).alias("cell_mean"))


@query(f"with {CELLS} select lat, lon, max(value) as value from c group by all")
def grid_merge(spark, sf_dir):
    c = cells(spark, sf_dir)
    parts = [A.cell_max(c.where(F.col("user_id") % 3 == k), [], ["lat", "lon"], "value", "value") for k in range(3)]
    return A.merged_grids(parts, ["lat", "lon"], "value")


@query("""with p as (select s_suppkey, (s_suppkey * 37) % 180 - 90 as y, (s_suppkey * 73) % 360 - 180 as x, s_acctbal as v from supplier),
g as (select a.i * 30 - 180 as x, b.i * 30 - 90 as y from range(13) a(i), range(7) b(i))
select cast(g.x as bigint) as x, cast(g.y as bigint) as y, round(sum(v / greatest(pow(g.x - p.x, 2) + pow(g.y - p.y, 2), 1e-10)) / sum(1 / greatest(pow(g.x - p.x, 2) + pow(g.y - p.y, 2), 1e-10)), 4) + 0.0 as value from g, p group by all""")
def idw(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    points = s.select(((F.col("s_suppkey") * 37) % 180 - 90).alias("y"), ((F.col("s_suppkey") * 73) % 360 - 180).alias("x"), F.col("s_acctbal").alias("v"))
    grid = spark.range(13).select((F.col("id") * 30 - 180).alias("x")).crossJoin(spark.range(7).select((F.col("id") * 30 - 90).alias("y")))
    return A.inverse_distance(grid, points, "x", "y", "v").select("x", "y", rounded("value", "value", 4))


@query("select event_type, count(v) as valid, count(*) as total, round(count(v) / count(*), 6) as coverage from (select event_type, case when event_id % 4 <> 1 then value end as v from events) group by all")
def coverage(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 4 != 1, F.col("value")))
    return A.coverage(df, ["event_type"], "v").select("event_type", "valid", "total", F.round("coverage", 6).alias("coverage"))


@query("""select user_id, strftime(min(ts), '%Y-%m-%d') as first_date, strftime(max(ts), '%Y-%m-%d') as last_date, array_to_string(list_sort(list(distinct event_type)), ',') as systems,
arg_min(n, case when trim(n) <> '' then ts end) as note from (select *, case when event_id % 3 = 0 then '' else 'n' || event_id end as n from events) group by all""")
def station_fold(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("note", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string")))).withColumn("systems", F.array("event_type"))
    r = A.station_fold(df, "user_id", "ts", "systems", ["note"])
    return r.select("user_id", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "systems", "note")


@query("select cast(ts as date)::varchar as day, cast(hour(ts) as bigint) as hour, count_if(value > 245)::bigint as visible, count(distinct user_id) as seen from events group by all")
def visible_count(spark, sf_dir):
    e = events(spark, sf_dir)
    e = e.select(F.col("ts").cast("date").cast("string").alias("day"), F.hour("ts").cast("long").alias("hour"), "user_id", "value")
    seen = A.counted(e.select("day", "hour", "user_id").distinct(), ["day", "hour"], {}, "seen")
    return A.counted(e, ["day", "hour"], {"visible": F.col("value") > 245}).join(seen, ["day", "hour"])


@query("""with n as (select user_id, event_type, count(*) as n from events group by all)
select user_id, arg_min(event_type, row(-n, event_type)) as event_type, round(max(n) / sum(n), 6) as share from n group by all""")
def dominant_combo(spark, sf_dir):
    return A.dominant(events(spark, sf_dir), ["user_id"], "event_type").select("user_id", "event_type", F.round("share", 6).alias("share"))


@query("select event_type, round(lo - 0.05 * (hi - lo), 5) as low, round(hi + 0.05 * (hi - lo), 5) as high from (select event_type, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events group by all)")
def robust_range(spark, sf_dir):
    return A.robust_range(events(spark, sf_dir), ["event_type"], "value").select("event_type", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("""with d as (select distinct event_type, user_id % 60 as x from events where value > 300), r as (select *, x - row_number() over (partition by event_type order by x) as r from d)
select event_type, min(x) as first, max(x) as last from r group by event_type, r""")
def range_compress(spark, sf_dir):
    df = events(spark, sf_dir).where("value > 300").withColumn("x", F.col("user_id") % 60)
    return A.number_ranges(df, ["event_type"], "x")


@query("""select user_id, max(event_type = 'error')::bigint as has_error, max(value > 480)::bigint as has_peak, min(value) as low, max(value) as high from events group by all""")
def system_presence(spark, sf_dir):
    e = events(spark, sf_dir)
    flags = A.present(e, ["user_id"], {"has_error": F.col("event_type") == "error", "has_peak": F.col("value") > 480})
    return flags.join(e.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high")), "user_id")


@query("""with s as (select n_regionkey as region, (s_suppkey * 37) % 180 - 90 as lat, (s_suppkey * 73) % 360 - 180 as lon from supplier join nation on s_nationkey = n_nationkey)
select cast(region as bigint) as region, greatest(min(lat) - 5, -90) as south, least(max(lat) + 5, 90) as north, greatest(min(lon) - 5, -180) as west, least(max(lon) + 5, 180) as east from s group by all""")
def bounding_box(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_regionkey").cast("long").alias("region"), ((F.col("s_suppkey") * 37) % 180 - 90).alias("lat"), ((F.col("s_suppkey") * 73) % 360 - 180).alias("lon"))
    return A.bounding_box(s, ["region"], "lat", "lon")


@query("select event_type, count(*) as n, count_if(value > 100)::bigint as high, count_if(value is null)::bigint as missing, sum(case when user_id % 2 = 0 then 1 else 0 end)::bigint as even from events group by all")
def scan_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    return A.counted(e, ["event_type"], {"high": F.col("value") > 100, "missing": F.col("value").isNull(), "even": F.col("user_id") % 2 == 0}, "n")


@query("""select event_type, count(*) as n from events group by all having count(case when value > 100 then 1 end) > 10""")
def acceptance(spark, sf_dir):
    return A.counted(events(spark, sf_dir), ["event_type"], {"k": F.col("value") > 100}, "n").where("k > 10").select("event_type", "n")


@query("""with r as (select l_suppkey, l_linenumber, sum(l_extendedprice) as v from lineitem group by all)
select l_suppkey, round(sum(case when l_linenumber = 1 then v end), 2) as c1, round(sum(case when l_linenumber = 2 then v end), 2) as c2, round(sum(case when l_linenumber = 3 then v end), 2) as c3 from r group by all""")
def epoch_matrix(spark, sf_dir):
    """The pivot behind fixed-width matrices: rows of one key, a column for each listed satellite."""
    li = A.matrix(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", [1, 2, 3], "l_extendedprice")
    return li.select("l_suppkey", *[F.round(str(k), 2).alias(f"c{k}") for k in (1, 2, 3)])
