"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Arrow batches for rows that hold whole texts: some MB each, so that a Python worker's memory stays small. A setting of the user's own stays.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
SPARK_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package also where the driver was started from another folder, and bounds their batches."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) in (None, SPARK_DEFAULTS[name]):
            spark.conf.set(name, value)
    return spark


def local_session(app: str = "ledgerline", cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench: UTC, AQE, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)
