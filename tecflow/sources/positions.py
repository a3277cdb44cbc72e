"""Station positions, site lists and names with dates in them; clocks on a full axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .products import field, text_lines


def read_solver_positions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, x, y, z): the last line of a positioning log that starts with OUTPUT and has a place on Earth in its 12th to 14th words."""
    lines = text_lines(spark, paths).select("file", "line", F.split(F.trim("value"), "\\s+").alias("p")).where("p[0] = 'OUTPUT' and size(p) >= 14")
    number = lambda k: F.get("p", F.lit(k)).try_cast("double")
    rows = lines.select("file", "line", *[number(11 + k).alias(c) for k, c in enumerate("xyz")]).where("abs(x) > 1000 and abs(y) > 1000 and abs(z) > 1000")
    return rows.groupBy("file").agg(F.max_by(F.struct(*"xyz"), "line").alias("p")).select("file", "p.*")


def read_site_positions(spark: SparkSession, paths: str | list[str], stations: DataFrame) -> DataFrame:
    """(station, x, y, z) from texts of words: the three numbers after a station's name, where it first stands before such."""
    words = spark.read.text(paths, wholetext=True).select(F.split(F.trim("value"), "\\s+").alias("w"))
    at = words.select("w", F.posexplode("w").alias("i", "word"))
    number = lambda k: F.get("w", F.col("i") + k).try_cast("double")
    rows = at.select(F.upper("word").alias("station"), "i", *[number(k).alias(c) for k, c in enumerate("xyz", 1)]).where("abs(x) > 1000 and y is not null and z is not null")
    wanted = stations.select(F.upper("station").alias("station")).distinct()
    return rows.join(wanted, "station").groupBy("station").agg(F.min_by(F.struct(*"xyz"), "i").alias("p")).select("station", "p.*")


def read_estimates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SINEX: station, point, solution, x, y, z and their deviations (m) from the block of estimated coordinates; of several files each gives its own rows."""
    lines = text_lines(spark, paths)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.last(F.when(F.substring("value", 1, 1).isin("+", "-"), F.when(F.col("value").startswith("+"), F.trim(F.substring("value", 2, 40))).otherwise("")), True).over(w)
    rows = lines.withColumn("block", block).where((F.col("block") == "SOLUTION/ESTIMATE") & F.substring("value", 1, 1).isin(" "))
    cells = rows.select("file", F.trim(F.substring("value", 8, 6)).alias("kind"), F.upper(F.trim(F.substring("value", 15, 4))).alias("station"), F.trim(F.substring("value", 20, 2)).alias("point"), F.trim(F.substring("value", 23, 4)).alias("solution"), field(47, 68).alias("v"), field(69, 80).alias("s"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return cells.where(F.col("kind").isin("STAX", "STAY", "STAZ")).groupBy("file", "station", "point", "solution").agg(*[pick(f"STA{c.upper()}", "v").alias(c) for c in "xyz"], *[pick(f"STA{c.upper()}", "s").alias(f"{c}_sigma") for c in "xyz"])


def read_site_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(station): the different words of four characters in site lists, in capitals."""
    words = spark.read.text(paths).select(F.explode(F.split(F.trim("value"), "\\s+")).alias("w"))
    return words.where(F.length("w") == 4).select(F.upper("w").alias("station")).distinct()


def named_for(pattern: Column, day: Column, site: Column | None = None) -> Column:
    """A file name with <YYYY>, <YEAR>, <YY>, <MONTH>, <DAY>, <DOY>, <GPSW>, <GPSWD> and <SITE> filled in; with _F or _B those of the day after or before."""
    out = pattern
    for end, shift in (("", 0), ("_F", 1), ("_B", -1)):
        d = F.date_add(day, shift)
        week = F.datediff(d, F.lit("1980-01-06").cast("date"))
        parts = {"YYYY": F.date_format(d, "yyyy"), "YEAR": F.date_format(d, "yyyy"), "YY": F.date_format(d, "yy"), "MONTH": F.date_format(d, "MM"), "DAY": F.date_format(d, "dd"), "DOY": F.date_format(d, "DDD")}
        parts["GPSW"] = F.lpad(F.floor(week / 7).cast("string"), 4, "0")
        parts["GPSWD"] = F.concat(parts["GPSW"], F.pmod(week, F.lit(7)).cast("string"))
        for name, value in parts.items():
            out = F.replace(out, F.lit(f"<{name}{end}>"), value)
    return out if site is None else F.replace(out, F.lit("<SITE>"), site)


def on_axis(clocks: DataFrame, step: float = 30.0, seconds: float = 86400.0) -> DataFrame:
    """(date, sat, epoch, bias_s) of clocks (sat, ts, bias_s): a row for every epoch of a satellite's day, from 0; of several in an epoch the last holds, an epoch without any has null."""
    second = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(86400.0))
    rows = clocks.select(F.to_date("ts").alias("date"), "sat", F.floor(second / step).cast("long").alias("epoch"), "ts", "bias_s")
    known = rows.groupBy("date", "sat", "epoch").agg(F.max_by("bias_s", "ts").alias("bias_s"))
    axis = rows.select("date", "sat").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(seconds / step) - 1).cast("long"))))
    return axis.join(known, ["date", "sat", "epoch"], "left")
