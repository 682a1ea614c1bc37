"""Lineage cuts in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and are no more than this; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of our own where it is unset on a local master, and nowhere else."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that goes when the process ends."""
    path = shared_path(spark, name)
    _made[path] = spark
    return path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read again: its lineage ends there. batch_rows: of the Arrow batches meanwhile, where rows may be large."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Tables of this process that are still there.
_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _sweep() -> None:
    """Results read these tables lazily, so the last of them go when the process ends."""
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            _delete(df.sparkSession, path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, counted here; else df, to be shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
