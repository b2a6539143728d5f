"""Bars and signals from a folder that grows, with Structured Streaming.

Closed bars come out in append mode behind a watermark, equal to those of a batch; in update mode the bar that is being filled
comes out too, as a poller that recomputes would show it.  Spark keeps which files it has read in the
checkpoint; a producer should add files and not append to them, as the file source reads a file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.market import safe_divide

TICK_SCHEMA = "record_num long, ts timestamp_ntz, price double, level_low double, level_high double, txn_count long, direction int, volume_delta long"


def stream_ticks(spark: SparkSession, folder: str, schema: str = TICK_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def stream_bars(ticks: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Bars by event time; ticks later than the watermark are dropped, so closed bars are final."""
    at = F.struct("ts", "record_num")
    t = ticks.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("txn_count")).otherwise(0))
    b = t.groupBy(F.window("event_time", width)).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("txn_count").alias("volume"), F.count("price").alias("num_events"), side(1).alias("buy_volume"), side(-1).alias("sell_volume"))
    imbalance = safe_divide((F.col("buy_volume") - F.col("sell_volume")).cast("double"), F.col("volume").cast("double"))
    return b.select(F.col("window.start").cast("timestamp_ntz").alias("bar_time"), *b.columns[1:], imbalance.alias("flow_imbalance"))


def watch(bars: DataFrame, history: str, signal: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: str = "5 seconds", once: bool = False, out: str | None = None):
    """Add closed bars to `history`, and give each batch's newest bars, with that history, to `signal`; its rows go to `out`.

    A batch that is run again after a failure replaces its own part of both folders.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        if out and not batch.isEmpty():
            known = batch.sparkSession.read.parquet(history).where(F.col("batch") <= number).drop("batch")
            signal(known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def replay(signals: DataFrame, tail: int = 30, least: int = 30) -> DataFrame:
    """The signals of the last `tail` bars, for bars that have at least `least` up to them (bar_seq from 0)."""
    last = signals.agg(F.max("bar_seq")).first()[0] or 0
    return signals.where((F.col("bar_seq") > last - tail) & (F.col("bar_seq") + 1 >= least))
