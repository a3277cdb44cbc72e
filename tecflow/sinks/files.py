"""Writers: series and grids as partitioned Parquet, fixed-width text matrices, conversions, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Names = Sequence[str]


def save_series(df: DataFrame, path: str, by: Names = ("metric", "date")) -> None:
    """One directory for each value of by, replaced as a whole, others left alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def wide_series(df: DataFrame, time: str, sat: str, value: str, sats: Names) -> DataFrame:
    """Compatibility form of a series: time, value for one satellite, or time, value_000, value_001 ... in the order of sats."""
    rows = df.groupBy(time).pivot(sat, list(sats)).agg(F.first(value, True))
    names = ["value"] if len(sats) == 1 else [f"value_{i:03d}" for i in range(len(sats))]
    return rows.select(F.col(time).alias("time"), *[F.col(f"`{s}`").alias(n) for s, n in zip(sats, names, strict=True)])


def long_grid(df: DataFrame, grid: str, dims: int = 2) -> DataFrame:
    """Rows dim0, dim1 (, dim2), value of a column of nested arrays."""
    out, names = df.select(F.col(grid).alias("_g")), []
    for d in range(dims):
        out = out.select(*names, F.posexplode("_g").alias(f"dim{d}", "_g"))
        names.append(f"dim{d}")
    return out.select(*names, F.col("_g").alias("value"))


def padded(columns: dict[str, DataFrame]) -> DataFrame:
    """One wide table of columns of unequal length (each: row, value), padded with null."""
    out = None
    for name, df in columns.items():
        side = df.select("row", F.col("value").alias(name))
        out = side if out is None else out.join(side, "row", "full")
    return out


def matrix_lines(df: DataFrame, epoch: str, prn: str, value: str, prns: Sequence[int], form: str = "%11.5f") -> DataFrame:
    """Lines 'Epoch 0001:' with a column for each satellite number; missing values are zero."""
    rows = df.groupBy(epoch).pivot(prn, list(prns)).agg(F.first(value, True))
    cells = [F.format_string(form, F.coalesce(F.col(str(p)), F.lit(0.0))) for p in prns]
    return rows.select(F.col(epoch).alias("epoch"), F.concat(F.format_string("Epoch %04d:", F.col(epoch).cast("int")), *cells).alias("value"))


def save_matrix(lines: DataFrame, path: str) -> None:
    """In order of epochs, over as many files as the sort makes."""
    lines.orderBy("epoch").select("value").write.mode("overwrite").text(path)


def block_lines(df: DataFrame, block: str, value: str) -> DataFrame:
    return df.select(F.col(block).alias("epoch"), F.format_string("Block %02d: %.5f", F.col(block).cast("int"), F.col(value)).alias("value"))


FORMATS = {".parquet": "parquet", ".json": "json", ".csv": "csv", ".orc": "orc"}


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Copies a data set into the format of the target's ending; other endings are refused."""
    kinds = [next((k for end, k in FORMATS.items() if p.rstrip("/").endswith(end)), None) for p in (source, target)]
    if None in kinds:
        raise ValueError(f"cannot convert {source} to {target}: known endings are {', '.join(FORMATS)}")
    read, write = spark.read.format(kinds[0]), None
    if kinds[0] == "csv":
        read = read.option("header", "true")
    write = read.load(source).write.mode("overwrite").format(kinds[1])
    (write.option("header", "true") if kinds[1] == "csv" else write).save(target)


def table_there(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at path. A swap that broke off between its two renames is undone first: the old table takes its place again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there, aside = hadoop(path.rstrip("/")), hadoop(path.rstrip("/") + ".old")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there) and fs.exists(aside):
        fs.rename(aside, there)
    return fs.exists(there)


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes a table beside the one at path, then puts the old one aside, the new one in its place, and deletes the old one: one of them is whole at any time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there, fresh, aside = (hadoop(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(fresh.toString())
    if table_there(spark, path):
        fs.delete(aside, True)
        fs.rename(there, aside)
    fs.rename(fresh, there)
    fs.delete(aside, True)


def upsert(spark: SparkSession, path: str, new: DataFrame, on: Names) -> DataFrame:
    """Puts rows of new in place of those of the same key in a Parquet table and adds the rest."""
    from ..operators.joins import replaced

    swap_in(spark, replaced(spark.read.parquet(path), new, on) if table_there(spark, path) else new, path)
    return spark.read.parquet(path)
