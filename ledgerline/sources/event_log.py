"""Event logs over tables: the canonical log of the events table, and a log of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Types of the canonical log that carry tags.
TAGGED = ("signup", "purchase")


def event_log(spark: SparkSession, sf_dir: str, versions: bool = True) -> DataFrame:
    """The events table as an event log. versions=False leaves streamversion out, and with it the only shuffle."""
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"), versions)


def as_log(events: DataFrame, versions: bool = True) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    payload = F.struct(F.col("value").alias("value"), k.alias("k"))
    tags = F.array_sort(F.array(F.concat(F.lit("user:"), F.col("user_id")), F.concat(F.lit("k:"), (k % 10).cast("string"))))
    log = events.select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("urn:testdata:events").alias("source"),
        F.lit("1.0").alias("specversion"),
        F.col("event_type").alias("type"),
        F.col("user_id").cast("string").alias("subject"),
        F.col("ts").alias("time"),
        F.lit("application/json").alias("datacontenttype"),
        F.to_json(payload).alias("data"),
        F.to_variant_object(payload).alias("data_v"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("streamid"),
        (F.col("event_id") + 1).alias("position"),
        F.when(F.col("event_type").isin(*TAGGED), tags).alias("dcbtags"),
        F.col("value"),
        k.alias("k"),
    )
    if versions:
        own = Window.partitionBy("streamid").orderBy("position")
        log = log.withColumn("streamversion", F.row_number().over(own).cast("long"))
    return log


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams: a turn is an event of its role's type."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("urn:testdata:conversations").alias("source"), F.col("role").alias("type"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("streamid"), (F.col("turn") + 1).alias("streamversion"), F.col("text").alias("subject"))


def backfilled(rows: DataFrame, order: list[str], seed: int = 0, slack: int = 0) -> DataFrame:
    """rows with positions where they had none: seed + slack + 1 and on, in the given order. Rows that have one keep it.

    Ranks come from a range partitioning: each row's place in its partition, and the rows of the partitions before, so that no
    task holds all rows.
    """
    old = rows.where(F.col("position").isNotNull())
    new = rows.where(F.col("position").isNull()).drop("position")
    return old.unionByName(numbered(new, order, "position", seed + slack).select(rows.columns))


def numbered(rows: DataFrame, order: list[str], name: str, before: int = 0) -> DataFrame:
    """rows with before + 1, before + 2, ... in a total order. The ranges' sizes go through the driver: a number per partition."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part, place = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")
    marked = written(dealt.select("*", part, place), "numbered")  # ranges are sampled anew each time: once only
    sizes = sorted(marked.groupBy("__part").count().collect())
    start, starts = before, []
    for r in sizes:
        starts.append((r["__part"], start))
        start += r["count"]
    base = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("__part")] if starts else F.lit(before)
    return marked.withColumn(name, (base + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__part", "__place")
