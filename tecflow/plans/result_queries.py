"""Selection, acceptance, matching and summaries, on events and files named after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N, signal as X
from ..operators import results as R
from .registry import query, rounded, table


def results(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    flag = F.when(e % 3 == 0, F.array(F.lit("NAV_FALLBACK_ENABLED"), F.lit("FORMAL_PIPELINE"))).otherwise(F.array(F.lit("FORMAL_PIPELINE")))
    return table(spark, sf_dir, "events").select(
        e.alias("result_id"), pick(["ROTI", "SIGMA_PHI_F", "AATR", "S4C"], e).alias("metric"), pick(["GPS", "GLO", ""], F.floor(e / 4)).alias("system"), F.col("event_type").alias("station"), "user_id", "ts", F.col("value"),
        pick(["FORMAL", "DEGRADED"], e).alias("chain"), F.lit("STANDARD_30S").alias("sampling"), pick(["orbit=x providers= A ", "none"], e).alias("sources"), flag.alias("flags"),
    )


RESULTS = "r as (select event_id as result_id, ['ROTI', 'SIGMA_PHI_F', 'AATR', 'S4C'][1 + event_id % 4] as metric, ['GPS', 'GLO', ''][1 + event_id // 4 % 3] as system, event_type as station, user_id, ts, value from events)"


@query(f"with {RESULTS} select result_id from r where system = 'GLO' and contains(upper(station), 'R') and not (metric = 'SIGMA_PHI_F' and system <> '' and system <> 'GPS')")
def result_filters(spark, sf_dir):
    return R.reportable(R.matching(results(spark, sf_dir), {"system": "GLO", "metric": None}, {"station": "r"})).select("result_id")


@query("select event_id from events where floor(epoch(ts)) % 86400 between 3600 and 40000 and (floor(epoch(ts)) % 86400 - 3600) % 4 = 0")
def time_slice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    second = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(86400))
    return R.between(e, second, 3600, 40000, 4).select("event_id")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events), s as (select user_id, min(n) as lo, max(n) as hi from e where event_type <> 'error' group by user_id)
select event_id, round(n * 0.25, 6) as hour from e join s using (user_id) where n between lo and hi""")
def trimmed_days(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return R.trimmed(e, ["user_id"], "n", "v", 96).select("event_id", rounded("hour", "hour"))


@query("select event_id from events where user_id % 32 in (1, 3, 4, 5, 6, 7, 12)")
def satellite_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("prn", F.col("user_id") % 32)
    return R.of_numbers(e, "prn", "[1,3 7,12]").select("event_id")


@query("""with c as (select distinct user_id as sat, cast(ts as date) as d, user_id % 7 <> 0 and (user_id + day(ts)) % 5 <> 0 as good from events), dead as (select sat from c group by sat having not bool_or(good))
select event_id from events e where user_id not in (select sat from dead) and not exists (select 1 from c where c.sat = e.user_id and c.d = cast(e.ts as date) and not good)""")
def good_clocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("sat", F.col("user_id")).withColumn("d", F.col("ts").cast("date"))
    good = (F.col("user_id") % 7 != 0) & ((F.col("user_id") + F.dayofmonth("ts")) % 5 != 0)
    clocks = e.select("sat", "d", F.when(good, 1e-5).otherwise(F.when(F.col("sat") % 2 == 0, 999999.999999)).alias("bias_s")).distinct()
    return R.with_good_clocks(e, clocks, ["sat", "d"]).select("event_id")


@query(f"with {RESULTS} select user_id, metric, count(case when value > 60 then value end) as n, count(case when value > 60 then value end) > case metric when 'AATR' then 5 when 'S4C' then 0 else 10 end as accepted from r group by user_id, metric")
def acceptance_by_metric(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("value", F.when(F.col("value") > 60, F.col("value")).otherwise(float("nan")))
    return R.accepted(rows, ["user_id"], "metric", "value").select("user_id", "metric", "n", "accepted")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events)
select event_type as station, cast(n // 3 as bigint) as hour, round(avg(value), 6) as mean from e where n // 3 < 24 and user_id % 9 <> 0 group by all""")
def station_hours(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    e = e.withColumn("value", F.when(F.col("user_id") % 9 == 0, float("nan")).otherwise(F.col("value")))
    return R.station_hours(e, "event_type", F.col("n"), 80, "value").select(F.col("event_type").alias("station"), "hour", rounded("mean", "mean"))


@query("select min(value) as least, max(value) as most from events where event_id % 5 <> 0 and value <> 0")
def value_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("value"))
    return R.value_range(e, "value")


@query("""select count(*) as result_count, (select string_agg(m || '=' || k, ',' order by m) from (select ['ROTI', 'SIGMA_PHI_F', 'AATR', 'S4C'][1 + event_id % 4] as m, count(*) as k from events group by all)) as metrics,
string_agg(distinct event_type, ',' order by event_type) as stations, string_agg(distinct case event_id % 2 when 0 then 'FORMAL' else 'DEGRADED' end, ',' order by case event_id % 2 when 0 then 'FORMAL' else 'DEGRADED' end) as chains,
string_agg(distinct case event_id % 2 when 0 then 'A' else '-' end, ',' order by case event_id % 2 when 0 then 'A' else '-' end) as providers, 'NAV_FALLBACK_ENABLED' as flags from events""")
def report_summary(spark, sf_dir):
    one = R.summary(results(spark, sf_dir))
    text = lambda c: F.array_join(c, ",").alias(c)
    metrics = F.array_join(F.transform(F.map_entries("metrics"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return one.select("result_count", metrics.alias("metrics"), text("stations"), text("chains"), text("providers"), text("flags"))


@query("select n_nationkey as report_id, case when n_regionkey < 3 then r_name else 'Default' end as name from nation join region on r_regionkey = n_regionkey")
def report_templates(spark, sf_dir):
    reports = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("report_id"), F.col("n_regionkey").alias("template_id"))
    templates = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("template_id"), F.col("r_name").alias("name"))
    return R.with_template(reports, templates, {"name": "Default"}).select("report_id", "name")


@query("select event_id, case when user_id % 4 <> 0 and event_id % 6 <> 0 then round(value - event_id % 6, 6) + 0.0 end as result from events")
def shape_equal_correction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    model = e.where("user_id % 4 <> 0 or event_id % 2 = 0 or event_id % 3 = 0").select("user_id", "event_id", (F.col("event_id") % 6).cast("double").alias("c"))
    model = model.union(e.where("user_id % 4 = 0").select("user_id", -F.col("event_id") - 1, F.lit(1.0)))
    return R.corrected(e, model, ["user_id"], ["event_id"], "value", "c").select("event_id", rounded("value", "result"))


@query("""with d as (select distinct cast(ts as date) as date from events), c as (select d.date, 'igs_b_' || strftime(date, '%Y%j') as path from d where day(date) % 3 <> 0)
select strftime(date, '%Y-%m-%d') as day, path as clock_path, 'a.atx' as antenna_path from c""")
def day_products(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    name = lambda s: F.concat(F.lit(f"igs_{s}_"), F.date_format("date", "yyyyDDD"))
    clocks = d.where(F.dayofmonth("date") % 3 != 0).select("date", F.explode(F.array(name("a"), name("b"))).alias("path"))
    antennas = spark.createDataFrame([("b.atx",), ("a.atx",)], "path string")
    return R.products_of_day(d, clocks, antennas).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "clock_path", "antenna_path")


@query("""with d as (select distinct strftime(ts, '%Y%j') as d from events) select 'clk_' || d || '.clk' as clock, 'a_' || d || '0000.sp3' as orbit from d""")
def paired_by_day(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyDDD").alias("d")).distinct()
    orbits = d.select(F.explode(F.array(F.concat(F.lit("a_"), "d", F.lit("0000.sp3")), F.concat(F.lit("b_"), "d", F.lit(".sp3")))).alias("name"))
    clocks = d.select(F.concat(F.lit("clk_"), "d", F.lit(".clk")).alias("name")).union(spark.createDataFrame([("none.clk",)], "name string"))
    return R.paired_products(orbits, clocks).select("clock", "orbit")


@query("""select distinct event_type as station, case when event_type like 'c%' then '/known/' || event_type else '/data/' || lower(substring(event_type, 1, 4)) || '0840.24o' end as path from events""")
def observation_paths(spark, sf_dir):
    stations = table(spark, sf_dir, "events").select(F.col("event_type").alias("station")).distinct()
    known = stations.where("station like 'c%'").select(F.upper("station").alias("station"), F.concat(F.lit("/known/"), "station").alias("path"))
    name = F.concat(F.lower(F.substring("station", 1, 4)), F.lit("0840.24o"))
    files = stations.select(name.alias("name"), F.concat(F.lit("/data/"), name).alias("path"))
    return R.observation_paths(stations, known, files)


@query("select o_orderkey as task_id from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 50")
def ready_queue(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "READY").otherwise("DONE").alias("status"))
    return R.ready_queue(tasks, 50).select("task_id")


@query("""select event_id, cast(case when m < 51544 then null when m < 53736 then 32 when m < 54832 then 33 when m < 56109 then 34 when m < 57204 then 35 when m < 57754 then 36 else 37 end as bigint) as leap
from (select event_id, 51000 + event_id % 8000 as m from events)""")
def leap_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.leap_seconds(51000 + F.col("event_id") % 8000).cast("long").alias("leap"))


@query(f"""with e as (select event_id, ['G', 'E', 'C', 'X'][1 + event_id % 4] as s, value from events)
select event_id, round(case when value <> 0 then value * case s when 'G' then {X.GPS[0]!r}e0 when 'E' then {X.GALILEO[0]!r}e0 when 'C' then {X.BEIDOU[0]!r}e0 end * case s when 'G' then {X.GPS[0]!r}e0 when 'E' then {X.GALILEO[0]!r}e0 when 'C' then {X.BEIDOU[0]!r}e0 end / 40.3e16 else value end, 4) + 0.0 as stec,
round({X.GPS[1]!r}e0 * {X.GPS[1]!r}e0 / ({X.GPS[0]!r}e0 * {X.GPS[0]!r}e0 - {X.GPS[1]!r}e0 * {X.GPS[1]!r}e0) * (value * 1e-9 * {X.LIGHT!r}e0), 6) + 0.0 as receiver from e""")
def positioning_content(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    system = F.get(F.array(*map(F.lit, "GECX")), (F.col("event_id") % 4).cast("int"))
    f1, _ = X.carriers(system, F.lit(1))
    g1, g2 = (F.lit(f) for f in X.GPS)
    return e.select("event_id", rounded(X.content_of_delay(F.col("value"), f1), "stec", 4), rounded(X.receiver_delay(F.col("value"), g1, g2), "receiver", 6))
