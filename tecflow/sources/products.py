"""Orbit, clock, antenna, bias and loading products, as line-wise expressions wherever a line says it all."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .rinex import files


def field(start: int, end: int, kind: str = "double") -> Column:
    """Columns start to end of a line, counted from 0, as a value; null if it is none."""
    return F.trim(F.substring("value", start + 1, end - start)).try_cast(kind)


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value, line): lines with their place in the file, so that blocks can be followed."""
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.where("value <> ''")


def time_of(*parts: Column) -> Column:
    return F.make_timestamp_ntz(*parts)


def read_orbits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SP3: sat, ts, x_km, y_km, z_km, clock_us; of repeated epochs the first one of the earliest file stays."""
    lines = text_lines(spark, paths)
    stamp = F.when(F.col("value").startswith("*"), time_of(field(3, 7, "int"), field(8, 10, "int"), field(11, 13, "int"), field(14, 16, "int"), field(17, 19, "int"), field(20, 31)))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("ts", F.last(stamp, True).over(w)).where(F.col("value").startswith("P") & F.col("ts").isNotNull())
    out = rows.select(F.replace(F.substring("value", 2, 3), F.lit(" "), F.lit("0")).alias("sat"), "ts", field(4, 18).alias("x_km"), field(18, 32).alias("y_km"), field(32, 46).alias("z_km"), field(46, 60).alias("clock_us"), "file", "line")
    out = out.where((F.col("x_km") != 0) | (F.col("y_km") != 0) | (F.col("z_km") != 0)).withColumn("clock_us", F.when(F.abs("clock_us") < 999999, F.col("clock_us")))
    first = Window.partitionBy("sat", "ts").orderBy("file", "line")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "file", "line")


def read_clocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """RINEX clock: sat, ts, bias_s. A satellite's line is AS, its name, six numbers of the time, how many values follow, and the bias; other lines are left out."""
    part = F.split(F.trim("value"), " +")
    number = lambda k, kind: F.get(part, F.lit(k)).try_cast(kind)
    rows = spark.read.text(paths).where(F.col("value").startswith("AS ")).select(F.get(part, F.lit(1)).alias("sat"), *[number(k, "int").alias(f"t{k}") for k in range(2, 7)], number(7, "double").alias("second"), number(9, "double").alias("bias_s"))
    known = F.col("sat").substr(1, 1).isin(*"GREC") & (F.length("sat") == 3) & F.col("bias_s").isNotNull() & F.col("second").isNotNull()
    return rows.where(known).select("sat", time_of(*[F.col(f"t{k}") for k in range(2, 7)], F.col("second")).alias("ts"), "bias_s")


#: Codes of older bias files, by system.
OLD_CODES = {"P1": "C1W", "C1": "C1C", "P2": "C2W", "C2": "C2C", "P5": "C5W", "C5": "C5Q"}


def modern_code(code: Column) -> Column:
    """Three-letter code of a two-letter one; others stay."""
    known = F.create_map(*[F.lit(x) for pair in OLD_CODES.items() for x in pair])
    return F.coalesce(known[F.upper(F.trim(code))], F.upper(F.trim(code)))


def read_biases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Code biases: scope (satellite or receiver), system, key (satellite or station), code1, code2, ns."""
    rows = spark.read.text(paths).where(F.col("value").rlike("^ (DSB|DCB) ") & (F.length("value") >= 80))
    site = F.trim(F.substring("value", 16, 4))
    sat = F.trim(F.substring("value", 12, 3))
    out = rows.select(F.when(site == "", "satellite").otherwise("receiver").alias("scope"), F.substring("value", 7, 1).alias("system"), F.when(site == "", sat).otherwise(F.upper(site)).alias("key"), modern_code(F.substring("value", 26, 4)).alias("code1"), modern_code(F.substring("value", 31, 4)).alias("code2"), F.trim(F.substring("value", 71, 22)).try_cast("double").alias("ns"))
    return out.where("ns is not null")


ANTENNAS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "key", "serial", "frequency")] + [T.StructField(n, T.DoubleType()) for n in ("north_mm", "east_mm", "up_mm")] + [T.StructField("zenith_mm", T.ArrayType(T.DoubleType()))])


def antennas(text: str) -> Iterator[tuple]:
    """Rows of ANTENNAS: a satellite's key is its id, a receiver's its type; zenith_mm is the pattern without azimuth."""
    kind = key = serial = band = None
    offset, pattern = None, []
    for line in text.splitlines():
        label = line[60:].strip()
        if label == "TYPE / SERIAL NO":
            name, serial = line[:20].strip(), line[20:40].strip()
            kind = "satellite" if len(serial) == 3 and serial[0] in "GRECJIS" and serial[1:].isdigit() else "receiver"
            key = serial if kind == "satellite" else name
        elif label == "START OF FREQUENCY":
            band, offset, pattern = line[3:6].strip(), None, []
        elif label == "NORTH / EAST / UP":
            offset = tuple(float(line[i : i + 10]) for i in (0, 10, 20))
        elif line[:8].strip() == "NOAZI":
            pattern = [float(x) for x in line[8:].split()]
        elif label == "END OF FREQUENCY" and offset:
            yield (kind, key, serial, band, *offset, pattern)


PATTERNS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "key", "serial", "frequency")] + [T.StructField(n, T.DateType()) for n in ("since", "until")]
    + [T.StructField(n, T.DoubleType()) for n in ("zenith_from", "zenith_step", "azimuth_step")] + [T.StructField("grid_mm", T.ArrayType(T.DoubleType()))]
)


def day_of(line: str) -> date | None:
    try:
        return date(*map(int, line.split()[:3]))
    except (TypeError, ValueError):
        return None


def patterns(text: str) -> Iterator[tuple]:
    """Rows of PATTERNS, one for each antenna and frequency: grid_mm has the values by zenith (a satellite's: nadir), azimuth after azimuth from 0 to 360; azimuth_step is 0 where there is but one row for all."""
    head: dict[str, object] = {}
    band, rows, plain = None, [], []
    for line in text.splitlines():
        label = line[60:].strip()
        if label == "START OF ANTENNA":
            head = {"since": None, "until": None, "azimuth": 0.0, "zenith": (0.0, 0.0, 5.0)}
        elif label == "TYPE / SERIAL NO":
            name, serial = line[:20].strip(), line[20:40].strip()
            satellite = len(serial) == 3 and serial[0] in "GRECJIS" and serial[1:].isdigit()
            head |= {"kind": "satellite" if satellite else "receiver", "key": serial if satellite else name, "serial": serial}
        elif label == "DAZI":
            head["azimuth"] = float(line[2:8])
        elif label == "ZEN1 / ZEN2 / DZEN":
            head["zenith"] = tuple(float(line[i : i + 6]) for i in (2, 8, 14))
        elif label in ("VALID FROM", "VALID UNTIL"):
            head["since" if label == "VALID FROM" else "until"] = day_of(line[:60])
        elif label == "START OF FREQUENCY":
            band, rows, plain = line[3:6].strip(), [], []
        elif label == "END OF FREQUENCY" and "kind" in head:
            around = round(360 / head["azimuth"]) + 1 if head["azimuth"] else 0
            whole = bool(around) and len(rows) == around and len({len(r) for r in rows}) == 1
            grid = [x for r in rows for x in r] if whole else plain
            if grid:
                yield (head["kind"], head["key"], head["serial"], band, head["since"], head["until"], head["zenith"][0], head["zenith"][2], head["azimuth"] if whole else 0.0, grid)
            band = None
        elif band and line[:8].strip() == "NOAZI":
            plain = [float(x) for x in line[8:].split()]
        elif band and not label.startswith("NORTH") and (parts := line.split()) and len(parts) > 2:
            try:
                rows.append([float(x) for x in parts[1:]])
            except ValueError:
                continue


LOADING = T.StructType([T.StructField("station", T.StringType()), T.StructField("coefficients", T.ArrayType(T.ArrayType(T.DoubleType())))])


def loading(text: str) -> Iterator[tuple]:
    """Ocean loading: a station and its six rows of eleven coefficients."""
    station, rows = None, []
    for line in text.splitlines():
        if line.startswith("$$"):
            continue
        parts = line.split()
        try:
            row = [float(p) for p in parts]
        except ValueError:
            station, rows = line.strip()[:4].upper(), []
            continue
        if station and len(row) == 11:
            rows.append(row)
            if len(rows) == 6:
                yield station, rows
                station = None


def parsed(spark: SparkSession, paths: str | list[str], parse, schema: T.StructType) -> DataFrame:
    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for content in pdf["content"]:
                yield pd.DataFrame(list(parse(bytes(content).decode("utf-8", "ignore"))), columns=schema.names)

    return files(spark, paths).mapInPandas(batches, schema)


def read_patterns(spark: SparkSession, paths: str | list[str], on: date | None = None) -> DataFrame:
    """PATTERNS of antenna files; with on, those valid on that day."""
    found = parsed(spark, paths, patterns, PATTERNS)
    if on is None:
        return found
    day = F.lit(on)
    return found.where((F.col("since").isNull() | (F.col("since") <= day)) & (F.col("until").isNull() | (F.col("until") >= day)))


def read_antennas(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parsed(spark, paths, antennas, ANTENNAS)


def read_loading(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parsed(spark, paths, loading, LOADING)


def read_index_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Index text files with lines 'Block 01: 0.11496': file, block, value."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    part = lambda k: F.regexp_extract("value", r"^\s*Block\s+(\d+):\s*([-\d.Ee+]+)", k)
    return rows.select("file", part(1).try_cast("int").alias("block"), part(2).try_cast("double").alias("value")).where("block is not null")


def read_epoch_matrix(spark: SparkSession, paths: str | list[str], width: int = 11) -> DataFrame:
    """Matrix text files with lines 'Epoch 0001:' and a column of width for each satellite: file, epoch, column (from 1), value; zeros are missing."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    head = r"^Epoch\s+(\d+):"
    body = F.regexp_replace("value", head, "")
    cells = F.expr(f"transform(sequence(0, cast(length(body) / {width} as int) - 1), i -> try_cast(trim(substring(body, i * {width} + 1, {width})) as double))")
    out = rows.where(F.col("value").rlike(head)).select("file", F.regexp_extract("value", head, 1).cast("int").alias("epoch"), body.alias("body")).where(F.length("body") >= width)
    return out.select("file", "epoch", F.posexplode(cells).alias("i", "value")).select("file", "epoch", (F.col("i") + 1).alias("column"), F.nullif(F.col("value"), F.lit(0.0)).alias("value"))
