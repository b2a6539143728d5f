"""Readers and writers of tables, trades, metrics and bars in files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import market

from .barfiles import BarFiles
from .scratch import path_of

TRADES = "entry_time timestamp_ntz, exit_time timestamp_ntz, direction string, entry_price double, exit_price double, sl_price double, tp_price double, exit_reason string, pnl_points double, pnl_dollars double, bars_held int, mae double, mfe double"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV by the name's end."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRADES)


def read_trades_json(spark: SparkSession, path: str) -> DataFrame:
    """A document {trades: [...]}; times go down to the minute."""
    t = spark.read.option("multiLine", True).json(path).select(F.explode("trades").alias("t")).select("t.*")
    return t.withColumns({c: F.col(c) - F.col(c) % 60 for c in ("entry_time", "exit_time")})


def write_ticks_csv(ticks: DataFrame, path: str) -> None:
    """Eleven columns, prices with two places, times with microseconds; ticks with cumulative_volume_delta."""
    money = lambda c: F.format_string("%.2f", c).alias(c)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    ticks.select("record_num", time, *map(money, ("price", "level_low", "level_high")), market.direction_name(F.col("direction")).alias("direction"), "txn_count", "volume_delta", "cumulative_volume_delta", "cumulative_txn", "flag").write.csv(path, header=True)


def write_bars_csv(bars: DataFrame, path: str) -> None:
    money = lambda c: F.format_string("%.2f", c).alias(c)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    bars.select("record_num", time, *map(money, ("open", "high", "low", "close")), "buy_count", "sell_count", "volume", "volume_delta", "cumulative_volume_delta", "cumulative_volume").write.csv(path, header=True)


def preview(df: DataFrame, order: str = "record_num", limit: int | None = 50) -> DataFrame:
    """The first rows; all if limit is 0 or None."""
    return df.orderBy(order).limit(limit) if limit else df.orderBy(order)


def write_trades_json(trades: DataFrame, path: str, generated_at: str | None = None) -> None:
    """One JSON document of trades with their result, and when it was made.  A viewer's list is small by nature."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).alias(c)
    row = F.struct(seconds("entry_time"), seconds("exit_time"), "direction", "entry_price", "sl_price", "tp_price", "exit_price", "exit_reason", "pnl_points", market.trade_result(F.col("pnl_points")).alias("result"))
    made = generated_at or datetime.now(timezone.utc).isoformat()
    doc = trades.agg(F.sort_array(F.collect_list(row)).alias("trades")).withColumn("generated_at", F.lit(made))
    doc.select(F.to_json(F.struct("trades", "generated_at")).alias("value")).coalesce(1).write.text(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.json(path)


def write_bar_files(bars: DataFrame, folder: str) -> int:
    """60-byte records, a file a day, by a task a day; files of days that are there already are replaced.  Returns the bars written.

    bars has bar_time, OHLC, buy_volume, sell_volume and volume; the cumulative volume runs over the day.
    """
    spark, seen = bars.sparkSession, Observation()
    spark.dataSource.register(BarFiles)
    d = bars.select(
        F.date_format("bar_time", "yyyy-MM-dd").alias("day"), market.dotnet_ticks(F.col("bar_time")).alias("ticks"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")),
        F.col("sell_volume").cast("long").alias("sell_count"), F.col("buy_volume").cast("long").alias("buy_count"), F.col("volume").cast("long").alias("volume"),
    )
    d = d.observe(seen, F.count(F.lit(1)).alias("n")).repartition("day").sortWithinPartitions("day", "ticks")
    d.write.format("bar_files").option("path", folder).mode("append").save()
    return seen.get["n"]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document (settings, a report) in any file system that Spark writes to."""
    fs, p = path_of(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, indent=1, default=str), path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_table(df: DataFrame, path: str) -> None:
    """CSV or Parquet by the name's end."""
    (df.write.mode("overwrite").csv(path, header=True) if path.rstrip("/").endswith(".csv") else df.write.mode("overwrite").parquet(path))
