"""Aggregations: hourly and blocked indices, statistics of results, grids and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Names = Sequence[str]


def hourly_rms(df: DataFrame, keys: Names, hour: Column, value: str, out: str = "rms") -> DataFrame:
    """Root mean square by key and hour of day, on a full axis of 24 hours; an hour without values has 0."""
    found = df.withColumn("hour", hour.cast("long")).groupBy(*keys, "hour").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(out))
    axis = df.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return axis.join(found, [*keys, "hour"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def block_rms(df: DataFrame, keys: Names, epoch: Column, size: int, value: str, weight: Column | None = None, out: str = "rms") -> DataFrame:
    """Root mean square over blocks of size epochs, counted from epoch 1; values are divided by weight."""
    x = F.col(value) if weight is None else F.col(value) / weight
    rows = df.withColumn("block", F.floor((epoch - 1) / size).cast("long")).withColumn("_x", x)
    return rows.groupBy(*keys, "block").agg(F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias(out), F.count("_x").alias("n"))


def statistics(df: DataFrame, keys: Names, value: str, threshold: float) -> DataFrame:
    """Least, most, mean, 95th percentile, share missing, and how many values exceed the threshold."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.95)).alias("p95"), F.avg(x.isNull().cast("double")).alias("missing"), F.count_if(x > threshold).alias("events"))


def difference_summary(left: DataFrame, right: DataFrame, on: Names, value: str) -> DataFrame:
    """One row: how many keys either side has alone, and mean and greatest absolute difference on the others."""
    a, b = left.select(*on, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(*on, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    d = F.abs(F.col("_a") - F.col("_b"))
    both = a.join(b, list(on), "full")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.avg(d).alias("mae"), F.max(d).alias("worst"))


def cell_max(df: DataFrame, keys: Names, cells: Names, value: str, out: str = "cell_max") -> DataFrame:
    return df.groupBy(*keys, *cells).agg(F.max(value).alias(out))


def cell_mean(df: DataFrame, keys: Names, cells: Names, value: str, out: str = "cell_mean") -> DataFrame:
    return df.groupBy(*keys, *cells).agg(F.avg(value).alias(out), F.count(value).alias("n"))


#: Values back from the last one whose weight, halved with each, still shows in a double.
FOLDED = 1075


def cell_running_mean(df: DataFrame, keys: Names, cells: Names, order: Column, value: str, out: str = "cell_mean") -> DataFrame:
    """The order-dependent fold that replaces a cell's value by the mean of it and the next one.

    The k-th value from the end weighs 2 ** -k, so only a cell's last values are
    ever collected.
    """
    by = [*keys, *cells]
    w = Window.partitionBy(*by).orderBy(F.desc("_o"), F.desc("_v"))
    last = df.where(F.col(value).isNotNull()).select(*by, order.alias("_o"), F.col(value).alias("_v")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= FOLDED)
    lists = last.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0]["_v"], lambda acc, x: (acc + x["_v"]) / 2)
    return lists.withColumn(out, fold).drop("s")


def merged_grids(grids: Sequence[DataFrame], cells: Names, value: str, how: str = "max") -> DataFrame:
    """Cell-wise maximum or mean of grids."""
    rows = grids[0].select(*cells, value)
    for g in grids[1:]:
        rows = rows.unionByName(g.select(*cells, value))
    return rows.groupBy(*cells).agg((F.max if how == "max" else F.avg)(value).alias(value))


def inverse_distance(cells: DataFrame, points: DataFrame, x: str, y: str, value: str, power: float = 2.0, floor: float = 1e-10, out: str = "value") -> DataFrame:
    """Mean of the points at every cell, weighing 1 / distance ** power. points is a station list and is broadcast by its size."""
    p = points.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(value).alias("_v")).where("_v is not null")
    square = F.greatest(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2), F.lit(floor))
    w = F.pow(square, -power / 2)
    names = cells.columns
    return cells.crossJoin(p).groupBy(*names).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(out))


def coverage(df: DataFrame, keys: Names, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("valid"), F.count("*").alias("total"), (F.count(value) / F.count("*")).alias("coverage"))


def rollup(stats: DataFrame, keys: Names, station: str) -> DataFrame:
    """Summary of results: how many, least of leasts, most of mosts, mean of means, all events, stations in order."""
    return stats.groupBy(*keys).agg(F.count("*").alias("results"), F.min("least").alias("least"), F.max("most").alias("most"), F.avg("mean").alias("mean"), F.sum("events").alias("events"), F.array_join(F.array_sort(F.collect_set(F.col(station).cast("string"))), ",").alias("stations"))


def station_fold(files: DataFrame, station: str, date: str, systems: str, described: Names) -> DataFrame:
    """One row a station: first and last date, all systems in order, first description that is not empty, by date."""
    texts = [F.min_by(d, F.when(F.trim(d) != "", F.col(date))).alias(d) for d in described]
    every = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(systems)))), ",")
    return files.groupBy(station).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), every.alias("systems"), *texts)


def dominant(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest, and its share."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value), (F.max("_n") / F.sum("_n")).alias("share"))


def robust_range(df: DataFrame, keys: Names, value: str, padding: float = 0.05) -> DataFrame:
    """1st and 99th percentile, widened by part of their distance."""
    p = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return p.select(*keys, (lo - padding * (hi - lo)).alias("low"), (hi + padding * (hi - lo)).alias("high"))


def number_ranges(df: DataFrame, keys: Names, number: str) -> DataFrame:
    """Distinct whole numbers of each key as runs: first, last."""
    rows = df.select(*keys, F.col(number).cast("long").alias("_x")).where("_x is not null").distinct()
    run = rows.withColumn("_r", F.col("_x") - F.row_number().over(Window.partitionBy(*keys).orderBy("_x")))
    return run.groupBy(*keys, "_r").agg(F.min("_x").alias("first"), F.max("_x").alias("last")).drop("_r")


def dilution(df: DataFrame, keys: Names, east: Column, north: Column, up: Column) -> DataFrame:
    """Sums of the normal matrix of unit line-of-sight vectors and a clock, and from its inverse GDOP and PDOP; null under four satellites."""
    names = ["e", "n", "u"]
    rows = df.select(*keys, east.alias("e"), north.alias("n"), up.alias("u"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("sats"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs], *[F.sum(a).alias(a) for a in names])
    # The clock's row and column are taken out first, which leaves a symmetric 3 x 3 matrix.
    c = {a + b: F.col(a + b) - F.col(a) * F.col(b) / F.col("sats") for a, b in pairs}
    minors = {"ee": c["nn"] * c["uu"] - c["nu"] * c["nu"], "nn": c["ee"] * c["uu"] - c["eu"] * c["eu"], "uu": c["ee"] * c["nn"] - c["en"] * c["en"]}
    cofactors = {"en": c["eu"] * c["nu"] - c["en"] * c["uu"], "eu": c["en"] * c["nu"] - c["eu"] * c["nn"], "nu": c["en"] * c["eu"] - c["nu"] * c["ee"]}
    det = c["ee"] * minors["ee"] + c["en"] * cofactors["en"] + c["eu"] * cofactors["eu"]
    inverse = {k: v / det for k, v in (minors | cofactors).items()}
    position = inverse["ee"] + inverse["nn"] + inverse["uu"]
    mean = {a: F.col(a) / F.col("sats") for a in names}
    clock = 1 / F.col("sats") + sum((mean[a] * mean[b] * inverse[a + b] * (1 if a == b else 2) for a, b in pairs), F.lit(0.0))
    ok = (F.col("sats") >= 4) & (F.abs(det) > 1e-12)
    return sums.select(*keys, "sats", F.when(ok, F.sqrt(position)).alias("pdop"), F.when(ok, F.sqrt(clock)).alias("tdop"), F.when(ok, F.sqrt(position + clock)).alias("gdop"))


def counted(df: DataFrame, keys: Names, conditions: dict[str, Column], total: str | None = None) -> DataFrame:
    """For each of keys the rows for which each condition holds, and with total all rows; a null condition does not hold."""
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(*keys).agg(*([F.count("*").alias(total)] if total else []), *counts)


def present(df: DataFrame, keys: Names, values: dict[str, Column]) -> DataFrame:
    """For each of keys 1 where any row has a value, else 0; zero and NaN stand for a missing measurement, false for no."""
    there = lambda c: F.coalesce((c.cast("double") != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    return df.groupBy(*keys).agg(*[F.max(there(c).cast("long")).alias(name) for name, c in values.items()])


def bounding_box(df: DataFrame, keys: Names, lat: str, lon: str, margin: float = 5.0) -> DataFrame:
    """For each of keys south, north, west and east of its places with a margin in degrees, within the globe; not for places on both sides of the date line."""
    low, high = (lambda c, x: F.greatest(F.min(c) - margin, F.lit(x))), (lambda c, x: F.least(F.max(c) + margin, F.lit(x)))
    return df.groupBy(*keys).agg(low(lat, -90).alias("south"), high(lat, 90).alias("north"), low(lon, -180).alias("west"), high(lon, 180).alias("east"))


def matrix(df: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """One line for each row and one column for each listed column; values of the same cell are added, missing cells are null."""
    return df.groupBy(row).agg(*[F.sum(F.when(F.col(column) == c, F.col(value))).alias(str(c)) for c in columns])
