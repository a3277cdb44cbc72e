"""Results, products and reports: selection, acceptance, matching of products, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Names = Sequence[str]

#: An index is accepted with more finite values than this, 10 where none is given.
ACCEPTED_ABOVE = {"AATR": 5, "S4C": 0}


def finite(x: Column) -> Column:
    """Value, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def matching(results: DataFrame, equal: dict[str, str | None] | None = None, contains: dict[str, str | None] | None = None) -> DataFrame:
    """Results whose columns equal the given values and hold the given texts in either case; empty conditions let all pass."""
    out = results
    for name, value in (equal or {}).items():
        out = out.where(F.col(name) == value) if value else out
    for name, text in (contains or {}).items():
        out = out.where(F.contains(F.upper(F.coalesce(F.col(name), F.lit(""))), F.upper(F.lit(text)))) if text else out
    return out


def reportable(results: DataFrame, ids: Sequence | None = None, foreign_sigma: bool = False) -> DataFrame:
    """Results of the given ids; the filtered phase index of systems other than GPS only where it is asked for."""
    out = results.where(F.col("result_id").isin(*ids)) if ids else results
    foreign = (F.col("metric") == "SIGMA_PHI_F") & (F.coalesce(F.col("system"), F.lit("")) != "") & (F.col("system") != "GPS")
    return out if foreign_sigma else out.where(~F.coalesce(foreign, F.lit(False)))


def between(df: DataFrame, seconds: Column, first: float, last: float, step: float | None = None) -> DataFrame:
    """Rows from first to last, and of these only those a whole number of steps after first."""
    out = df.where(seconds.between(first, last))
    return out.where(F.pmod(seconds - first, F.lit(step)) == 0) if step else out


def trimmed(df: DataFrame, keys: Names, epoch: str, value: str, epochs: int, hours: float = 24.0) -> DataFrame:
    """Rows between a key's first and last epoch that has any value, with the hour an epoch ends at; keys without values go."""
    seen = df.where(finite(F.col(value)).isNotNull()).groupBy(*keys).agg(F.min(epoch).alias("_lo"), F.max(epoch).alias("_hi"))
    inside = df.join(seen, list(keys)).where(F.col(epoch).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return inside.withColumn("hour", F.col(epoch) * (hours / epochs))


def numbers_of(text: str) -> list[int]:
    """Numbers of a list like [1,3 7,12]: two numbers parted by a blank are a range with both its ends."""
    out: set[int] = set()
    for part in text.strip().strip("[]").split(","):
        ends = [int(x) for x in part.split()]
        if ends:
            out |= set(range(ends[0], ends[-1] + 1))
    return sorted(out)


def of_numbers(df: DataFrame, number: str, text: str) -> DataFrame:
    """Rows of the satellites in a list as numbers_of reads it; all rows for 'all'."""
    return df if text.strip() == "all" else df.where(F.col(number).isin(numbers_of(text)))


def with_good_clocks(obs: DataFrame, clocks: DataFrame, on: Names, sat: str = "sat", bias: str = "bias_s") -> DataFrame:
    """obs without satellites that have no clock at all, and without the epochs (on) at which theirs is missing; satellites the clocks don't list stay."""
    value = F.when(finite(F.col(bias)).isNotNull() & (F.col(bias) != 999999.999999), F.col(bias))
    rows = clocks.select(*dict.fromkeys([sat, *on]), value.alias("_b"))
    dead = rows.groupBy(sat).agg(F.count("_b").alias("_n")).where("_n = 0").select(sat)
    gaps = rows.where("_b is null").select(*on).distinct()
    return obs.join(dead, sat, "left_anti").join(gaps, list(on), "left_anti")


def accepted(df: DataFrame, keys: Names, metric: str, value: str) -> DataFrame:
    """(keys, n, accepted): whether a result has enough finite values for its metric."""
    n = F.count(finite(F.col(value)))
    least = F.coalesce(F.create_map(*[F.lit(x) for pair in ACCEPTED_ABOVE.items() for x in pair])[F.col(metric)], F.lit(10))
    return df.groupBy(*dict.fromkeys([*keys, metric])).agg(n.alias("n")).withColumn("accepted", F.col("n") > least)


def station_hours(df: DataFrame, station: str, epoch: Column, epochs: int, value: str, hours: int = 24) -> DataFrame:
    """(station, hour, mean): mean over all satellites and epochs of an hour; hours without values are left out, epochs past the last whole hour too."""
    hour = F.floor(epoch / max(1, epochs // hours)).cast("long")
    rows = df.select(station, hour.alias("hour"), finite(F.col(value)).alias("_v")).where(F.col("hour") < hours)
    return rows.groupBy(station, "hour").agg(F.avg("_v").alias("mean")).where("mean is not null")


def value_range(df: DataFrame, value: str) -> DataFrame:
    """(least, most) of all values but zeros and NaNs."""
    x = finite(F.col(value))
    return df.agg(F.min(F.when(x != 0, x)).alias("least"), F.max(F.when(x != 0, x)).alias("most"))


def provider_of(summary: Column) -> Column:
    """What follows providers= in a result's source summary, else -."""
    text = F.trim(F.coalesce(summary, F.lit("")))
    at = F.locate("providers=", text)
    return F.when(at > 0, F.trim(F.substr(text, at + F.lit(len("providers="))))).otherwise("-")


def summary(results: DataFrame) -> DataFrame:
    """One row: result_count, metrics (map of counts), sorted sets of stations, chains, samplings and providers, and the union of the flags arrays; FORMAL_PIPELINE only where it is the only flag."""
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    sets = lambda c: F.array_sort(F.collect_set(c))
    counts = results.groupBy(F.coalesce("metric", F.lit("UNKNOWN")).alias("m")).agg(F.count("*").alias("k")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "k")))).alias("metrics"))
    provider = F.when(some("sources").isNotNull(), provider_of(F.col("sources")))
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags"))))
    one = results.agg(F.count("*").alias("result_count"), sets(some("station")).alias("stations"), sets(some("chain")).alias("chains"), sets(some("sampling")).alias("samplings"), sets(provider).alias("providers"), flags.alias("flags"))
    kept = F.when(F.col("result_count") == 0, F.array(F.lit("NO_RESULT_SELECTED"))).when(F.size("flags") > 1, F.array_remove("flags", "FORMAL_PIPELINE")).otherwise(F.col("flags"))
    return one.withColumn("flags", kept).crossJoin(counts)  # one row each


def with_template(reports: DataFrame, templates: DataFrame, default: dict[str, str]) -> DataFrame:
    """reports with the columns of their template, by template_id, or those of the default."""
    t = templates.select(F.col("template_id"), *[F.col(c).alias(f"_{c}") for c in default], F.lit(True).alias("_hit")).dropDuplicates(["template_id"])
    joined = reports.join(t, "template_id", "left")
    return joined.select(*reports.columns, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.lit(v)).alias(c) for c, v in default.items()])


def corrected(df: DataFrame, model: DataFrame, keys: Names, on: Names, value: str, correction: str) -> DataFrame:
    """value less its correction, for each of keys only if the model has the same rows (on) as df; null else, and where the correction is null or zero."""
    by = [*keys, *on]
    both = df.select(*by, F.lit(1).alias("_l")).join(model.select(*by, F.lit(1).alias("_r")), by, "full")
    same = both.groupBy(*keys).agg((F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0).alias("_same"))
    joined = df.join(model.select(*by, F.nullif(F.col(correction), F.lit(0.0)).alias("_c")), by, "left").join(same, list(keys), "left")
    return joined.select(*[F.when(F.col("_same"), F.col(value) - F.col("_c")).alias(value) if c == value else F.col(c) for c in df.columns])


def products_of_day(days: DataFrame, clocks: DataFrame, antennas: DataFrame, date: str = "date", path: str = "path") -> DataFrame:
    """days that have a clock product, with its path, and the first antenna file, which holds for all days; a date's last clock wins."""
    clk = clocks.groupBy(date).agg(F.max(path).alias("clock_path"))
    return days.join(clk, date).crossJoin(F.broadcast(antennas.agg(F.min(path).alias("antenna_path"))))  # one row


def paired_products(orbits: DataFrame, clocks: DataFrame, name: str = "name") -> DataFrame:
    """(clock, orbit) file names that hold the same first seven digits, the first orbit of several; without any such pair, by their places in order."""
    day = lambda c: F.nullif(F.regexp_extract(c, "[0-9]{7}", 0), F.lit(""))
    o = orbits.select(F.col(name).alias("orbit"))
    c = clocks.select(F.col(name).alias("clock"), day(F.col(name)).alias("_d"))
    runs = o.select("orbit", F.explode(F.regexp_extract_all("orbit", F.lit("(?=([0-9]{7}))"), F.lit(1))).alias("_d"))
    dated = c.join(runs, "_d").groupBy("clock").agg(F.min("orbit").alias("orbit"))
    # Product files of a task are few; their places are numbered in one task.
    at = lambda df, k: df.withColumn("_i", F.row_number().over(Window.orderBy(k)))
    placed = at(c.select("clock"), "clock").join(at(o, "orbit"), "_i").where("_i <= 2").select("clock", "orbit")
    none = dated.agg((F.count("*") == 0).alias("_none"))
    return dated.union(placed.crossJoin(none).where("_none").select("clock", "orbit"))


def observation_paths(wanted: DataFrame, known: DataFrame, files: DataFrame, station: str = "station") -> DataFrame:
    """wanted with path: the one known for its station, else that of the first file whose name starts with the station."""
    k = known.select(F.upper(station).alias("_s"), F.col("path").alias("_known")).dropDuplicates(["_s"])
    f = files.groupBy(F.upper(F.substring("name", 1, 4)).alias("_p")).agg(F.min("path").alias("_found"))
    s = F.upper(F.col(station))
    joined = wanted.join(k, s == F.col("_s"), "left").join(f, F.substring(s, 1, 4) == F.col("_p"), "left")
    return joined.select(*wanted.columns, F.coalesce("_known", "_found").alias("path"))


def ready_queue(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Tasks that are READY, the oldest first."""
    rows = tasks.where("status = 'READY'").orderBy("created_at", "task_id")
    return rows if limit is None else rows.limit(limit)
