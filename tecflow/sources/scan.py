"""Directory scan: what a file is, whose and of which day, by its name alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import date_of_name

#: Kind of a file by its ending.
KINDS = {".sp3": "SP3", ".clk": "CLK", ".atx": "ATX", ".nav": "NAV", ".csv": "SPACE_WEATHER", ".txt": "SPACE_WEATHER"}
GLOBAL_KINDS = ("ATX",)


def kind_of(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.rlike(r"\.(rnx|obs)$") | low.rlike(r"\.\d{2}o$"), "OBS")
    for ending, kind in KINDS.items():
        out = out.when(low.endswith(ending), kind)
    return out.when(low.contains("space_weather"), "SPACE_WEATHER")


def scan(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """(path, name, kind, station, date, size) of all files of a known kind under roots; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select("path", name.alias("name"), F.col("length").alias("size"))
    rows = rows.select("path", "name", kind_of(F.col("name")).alias("kind"), date_of_name(F.col("name")).alias("date"), "size").where("kind is not null")
    return rows.withColumn("station", F.when(F.col("kind") == "OBS", F.upper(F.substring("name", 1, 4))))


def kinds_by_day(found: DataFrame) -> DataFrame:
    """(date, kinds, chain): kinds of files there for each day, undated and global ones included, and what can be computed from them."""
    everywhere = found.where(F.col("date").isNull() | F.col("kind").isin(*GLOBAL_KINDS)).agg(F.collect_set("kind").alias("g"))
    days = found.where("date is not null").groupBy("date").agg(F.collect_set("kind").alias("d")).crossJoin(everywhere)
    kinds = F.array_sort(F.array_union("d", "g"))
    has = lambda *k: F.array_contains(F.col("kinds"), k[0]) if len(k) == 1 else F.array_contains(F.col("kinds"), k[0]) & has(*k[1:])
    chain = F.when(has("OBS", "SP3", "CLK", "ATX"), "FORMAL").when(has("OBS", "SP3"), "EXPERIMENTAL").when(has("OBS", "NAV"), "DEGRADED").otherwise("INCOMPLETE")
    return days.select("date", kinds.alias("kinds")).withColumn("chain", chain)
