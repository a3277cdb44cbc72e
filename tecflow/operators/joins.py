"""Joins between observations, products and stations. Small sides are left to the planner, which broadcasts them by their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Names = Sequence[str]


def expanded(stations: DataFrame, systems: DataFrame, first: Column, last: Column, out: str = "date") -> DataFrame:
    """A row for every station, system and day from first to last."""
    return stations.crossJoin(systems).withColumn(out, F.explode(F.sequence(first, last, F.expr("interval 1 day"))))


def missing(wanted: DataFrame, there: DataFrame, on: Names) -> DataFrame:
    return wanted.join(there, list(on), "left_anti")


def neighbours(days: DataFrame, keys: Names, date: str, other: str) -> DataFrame:
    """Every day with the last product of the days before, of the day itself and of the days after; null where there is none."""
    product = F.col(other)
    w = Window.partitionBy(*keys).orderBy(date)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    return days.select(*keys, date, F.last(product, True).over(back).alias("previous"), product.alias("same"), F.first(product, True).over(ahead).alias("next"))


def at_or_before(left: DataFrame, right: DataFrame, keys: Names, time: str, values: Names) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time; one shuffle, no range join."""
    cols = left.columns
    marked = left.select(*cols, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side"))
    fill = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (*keys, time) else F.col(c) for c in cols]
    both = marked.unionByName(right.select(*fill, *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side")))
    seen = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), True).over(seen)
    return both.withColumn("_r", packed).where("_side = 1").select(*cols, *[F.col(f"_r._{v}").alias(v) for v in values])


def matching_or_any(items: DataFrame, products: DataFrame, date: str, product_date: str) -> DataFrame:
    """items for which a product of that date, or one without a date, is there: an equality join and one flag, not a condition on either."""
    d = F.col(product_date)
    dates = products.where(d.isNotNull()).select(d.alias("_d")).distinct().withColumn("_hit", F.lit(True))
    undated = products.agg(F.coalesce(F.bool_or(d.isNull()), F.lit(False)).alias("_any"))
    both = items.join(dates, F.col(date) == F.col("_d"), "left").crossJoin(undated)
    return both.where("_any or coalesce(_hit, false)").select(*items.columns)


def lagrange_weights(phase: Column, order: int = 10) -> list[Column]:
    """Weights of order equally spaced anchors at offsets 1 - order / 2 to order / 2, for a point phase (0 to 1) after offset 0."""
    offsets = range(1 - order // 2, order // 2 + 1)
    out = []
    for j in offsets:
        w = F.lit(1.0)
        for m in offsets:
            if m != j:
                w = w * (phase - m) / float(j - m)
        out.append(w)
    return out


def interpolated(targets: DataFrame, anchors: DataFrame, keys: Names, time: str, step: float, values: Names, order: int = 10) -> DataFrame:
    """targets with values interpolated from the order nearest anchors of their key, which are step apart.

    An anchor's number is its time over step. Every anchor gets the values around
    it once, so a target meets a single row, by equality. Targets without all
    their anchors get null; equal targets each get their value.
    """
    offsets = range(1 - order // 2, order // 2 + 1)
    number = F.rint(F.col(time) / step).cast("long")
    known = anchors.select(*keys, number.alias("_k"), *[F.col(v).alias(f"_{v}") for v in values]).dropDuplicates([*keys, "_k"])
    w = Window.partitionBy(*keys).orderBy("_k")
    around = lambda v: [F.when(F.lead("_k", j).over(w) == F.col("_k") + j, F.lead(f"_{v}", j).over(w)) for j in offsets]
    wide = known.select(*keys, "_k", *[F.array(*around(v)).alias(f"_{v}") for v in values])
    at = targets.withColumn("_k", F.floor(F.col(time) / step).cast("long")).withColumn("_p", F.col(time) / step - F.col("_k"))
    weighted = lambda v: sum((w * F.get(f"_{v}", F.lit(i)) for i, w in enumerate(lagrange_weights(F.col("_p"), order))), F.lit(0.0))
    joined = at.join(wide, [*keys, "_k"], "left")
    return joined.select(*[joined[c] for c in targets.columns], *[weighted(v).alias(v) for v in values])


def bracketed(targets: DataFrame, anchors: DataFrame, keys: Names, time: str, value: str, step: float | None = None) -> DataFrame:
    """targets with value interpolated on the straight line between the anchors around them; beyond the ends, null.

    Without step all rows of a key are one window. With step only its anchors are: the
    span between two of them is listed under every stretch of step that it reaches, and
    a target meets its span by equality, so that a key may have any number of targets.
    """
    if step is not None:
        return spanned(targets, anchors, keys, time, value, step)
    rows = targets.select(*targets.columns, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side"))
    fill = [F.col(c) if c in (*keys, time) else F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in targets.columns]
    both = rows.unionByName(anchors.select(*fill, F.col(value).alias("_v"), F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    point = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    back = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", back).withColumn("_a", ahead).where("_side = 1")
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(time) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    return near.select(*targets.columns, F.when(F.col("_b.t") == F.col(time), F.col("_b.v")).otherwise(line).alias(value))


def spanned(targets: DataFrame, anchors: DataFrame, keys: Names, time: str, value: str, step: float) -> DataFrame:
    """bracketed, by spans between anchors; of anchors at one time any counts."""
    w = Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_t")
    known = anchors.where(F.col(time).isNotNull()).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(time).alias("_t"), F.col(value).alias("_v")).dropDuplicates([*[f"_of_{k}" for k in keys], "_t"])
    spans = known.withColumns({"_u": F.lead("_t").over(w), "_w": F.lead("_v").over(w)})
    number = lambda t: F.floor(F.col(t) / step).cast("long")
    spans = spans.withColumn("_k", F.explode(F.sequence(number("_t"), F.coalesce(number("_u"), number("_t")))))
    at = targets.withColumn("_at", number(time))
    inside = (F.col(time) >= F.col("_t")) & F.coalesce(F.col(time) < F.col("_u"), F.col(time) == F.col("_t"))
    met = at.join(spans, [*[at[k] == spans[f"_of_{k}"] for k in keys], at["_at"] == spans["_k"], inside], "left")
    line = F.col("_v") + (F.col("_w") - F.col("_v")) * (F.col(time) - F.col("_t")) / (F.col("_u") - F.col("_t"))
    return met.select(*[at[c] for c in targets.columns], F.when(F.col("_t") == F.col(time), F.col("_v")).otherwise(line).alias(value))


def station_pairs(df: DataFrame, station: str, on: Names, values: Names) -> DataFrame:
    """Values of every two stations that share the columns on, the smaller name first."""
    a = df.select(*on, F.col(station).alias("station_a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = df.select(*on, F.col(station).alias("station_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, list(on)).where("station_a < station_b")


def gradient_counts(change: Column, distance_km: Column, levels: Sequence[float], reach_km: float = 1000.0) -> Column:
    """At how many levels (change / level) cubed times reach / distance comes to one or more; 0 beyond reach."""
    hits = [F.when(F.pow(F.abs(change) / level, 3) * (reach_km / distance_km) >= 1, 1).otherwise(0) for level in levels]
    return F.when(distance_km <= reach_km, sum(hits[1:], hits[0])).otherwise(0)


def gradient_index(cells: DataFrame, keys: Names, pair: Names, cell: Names, value: str) -> tuple[DataFrame, DataFrame]:
    """(index by key, map by key and cell) from counts of station pairs in cells: sum over pairs of cell maxima over their number, and their maximum."""
    most = cells.groupBy(*keys, *pair, *cell).agg(F.max(value).alias("_m"))
    return most.groupBy(*keys).agg((F.sum("_m") / F.count("_m")).alias("index")), most.groupBy(*keys, *cell).agg(F.max("_m").alias("value"))


def biases(df: DataFrame, satellite: DataFrame, receiver: DataFrame, sat_on: Names, rec_on: Names) -> DataFrame:
    """df with satellite_ns and receiver_ns, 0 where a bias is not known."""
    out = df.join(satellite.select(*sat_on, F.col("ns").alias("satellite_ns")), list(sat_on), "left").join(receiver.select(*rec_on, F.col("ns").alias("receiver_ns")), list(rec_on), "left")
    return out.withColumn("satellite_ns", F.coalesce("satellite_ns", F.lit(0.0))).withColumn("receiver_ns", F.coalesce("receiver_ns", F.lit(0.0)))


def of_prefix(files: DataFrame, stations: DataFrame, name: str, code: str, length: int = 4) -> DataFrame:
    """files whose name starts with the code of a station, in either case."""
    codes = stations.select(F.upper(F.substring(code, 1, length)).alias("_c")).distinct()
    return files.join(codes, F.upper(F.substring(name, 1, length)) == F.col("_c"), "left_semi")


def by_either(results: DataFrame, stations: DataFrame, key: str, first: str, second: str, values: Names) -> DataFrame:
    """results with station values, found by one name and, failing that, by another: two joins on equality instead of one on either."""
    one = stations.select(F.col(first).cast("string").alias("_1"), *[F.col(v).alias(f"_1{v}") for v in values]).dropDuplicates(["_1"])
    two = stations.select(F.col(second).cast("string").alias("_2"), *[F.col(v).alias(f"_2{v}") for v in values]).dropDuplicates(["_2"])
    k = F.col(key).cast("string")
    joined = results.join(one, k == F.col("_1"), "left").join(two, k == F.col("_2"), "left")
    return joined.select(*results.columns, *[F.coalesce(f"_1{v}", f"_2{v}").alias(v) for v in values])


def replaced(old: DataFrame, new: DataFrame, on: Names) -> DataFrame:
    """old with the rows of new put in place of those of the same key, and added where there is none."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new)

