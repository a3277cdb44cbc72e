"""What the corpus operators share: the cluster's shared folder, staged tables, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the context's; where neither is set a new one becomes the context's on one machine, and on a cluster it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tecflow-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: With this setting Spark deletes a query's shuffle files when the query ends.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors cost a re-read, and no shuffle files stay."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHORT_SHUFFLES)
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            jvm = df.sparkSession._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


#: Rows that are broadcast at most, and bytes they may have.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def bounded(df: DataFrame, width: Column | int = 64) -> DataFrame:
    """df, marked for broadcast if it has few rows and bytes; width: bytes of a row. Beyond the bounds joins shuffle it."""
    n, size = df.agg(F.count("*"), F.sum(width if isinstance(width, Column) else F.lit(width))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


#: Rows of texts that go to a worker at a time, where the session has Spark's default: texts are long, and a batch stands in both processes.
TEXT_ROWS, BATCHES = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(program: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """program for mapInArrow over texts, after whose partition freed memory goes back to the system: idle workers share their executor's memory with later stages.

    Where the session has Spark's default number of rows in a batch, it gets TEXT_ROWS.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCHES) == "10000":
        spark.conf.set(BATCHES, TEXT_ROWS)

    @functools.wraps(program)
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from program(found)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def rows_where(docs: DataFrame, text_col: str, stays: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of docs whose text stays, by a mask for a batch of texts; no shuffle, and ids don't matter."""
    at = docs.columns.index(text_col)

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array(stays(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates two steps on the edge list until it stands still: every node hands
    its smallest neighbour to its larger neighbours, then to its smaller ones.
    Each round is staged in the shared folder. Only counts reach the driver.
    Null ends and loops are left out; an empty list gives an empty table.
    """
    spark = edges.sparkSession
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now = staged(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_staged(now, large)
        now, before, seen = after, seen, mark(after)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select(F.col("component"), F.col("component")).distinct())
