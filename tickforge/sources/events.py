"""The `events` table as a tick stream: a deterministic adapter in quarter points, so that all sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import market
from tickforge.operators.ordering import prefix_sums, time_block

from .cache import cached


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_num, ts, tick_no, price, level_low, level_high, txn_count, direction, volume_delta, session_date, source_file: decoded once for all queries."""
    return cached(spark, "ticks", f"{sf_dir}/events.parquet", lambda: decoded(spark, sf_dir))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = prefix_sums(e, time_block("ts"), ["ts", "event_id"], {"walk": (F.col("k") % 9 - 4).cast("long"), "count": F.lit(1).cast("long")})
    price = 4000 + 0.25 * F.col("walk")
    spread = 1.0 + F.col("event_id") % 2
    side = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("click", "view"), -1).otherwise(0)
    t = e.select(
        F.col("event_id").alias("record_num"),
        "ts",
        (F.col("count") - 1).alias("tick_no"),
        price.alias("price"),
        F.when(side == 1, price - spread).when(side == -1, price).otherwise(price - spread / 2).alias("level_low"),
        F.when(side == 1, price).when(side == -1, price + spread).otherwise(price + spread / 2).alias("level_high"),
        (F.col("k") + 1).cast("long").alias("txn_count"),
    )
    return enrich(t).withColumn("source_file", F.lit("events"))


def enrich(t: DataFrame) -> DataFrame:
    """Ticks with direction, signed volume and session."""
    t = t.withColumn("direction", market.direction(F.col("price"), F.col("level_low"), F.col("level_high")))
    return t.withColumn("volume_delta", F.col("direction") * F.col("txn_count")).withColumn("session_date", market.session_date(F.col("ts")))
