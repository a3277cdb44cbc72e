"""Session defaults shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int | None = None, app: str = "tecflow") -> SparkSession:
    """A session with UTC clocks, adaptive execution and Arrow.

    What the cluster sets (spark-submit, spark-defaults) wins. Only where no master
    is set, or one is given, is this one machine, with shuffles for its cores.
    """
    cores = cores or os.cpu_count() or 4
    conf = SparkConf()
    local = master or (None if conf.contains("spark.master") else os.environ.get("SPARK_MASTER") or f"local[{cores}]")
    if local:
        conf.setMaster(local)
        if local.startswith("local"):
            conf.setIfMissing("spark.sql.shuffle.partitions", str(cores)).setIfMissing("spark.driver.memory", os.environ.get("TECFLOW_DRIVER_MEMORY", "8g"))
    defaults = {
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false" if local else "true",
    }
    for name, value in defaults.items():
        conf.setIfMissing(name, value)
    return SparkSession.builder.config(conf=conf).getOrCreate()
