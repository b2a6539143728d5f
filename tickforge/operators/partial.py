"""Bars from partial bars that merge: what a slice of a bar's ticks says is kept, and slices are put together without their ticks.

All sums and extremes merge in any order, open and close go by (ts, record_num), and runs merge in order of time: a slice keeps its first run, its last run and
its best ones, and where one slice ends with the direction that the next begins with, the two runs are one.  So a bar of a day is made by
as many tasks as it has slices, and bars over many files are made again from the files that have changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import bar_time, with_ratios
from .ordering import BLOCK_SECONDS, time_block

#: Columns of a partial bar that are summed, and those of which the largest counts.
SUMS = ("volume", "num_events", "buy_volume", "sell_volume", "wide", "spreads", "price_volume")
TOPS = ("high", "max_single_txn", "max_single_buy", "max_single_sell")
RUN = ("from_at", "to_at", "first_side", "first_run", "last_side", "last_run", "best_buy", "best_sell", "n")


def partial_bars(ticks: DataFrame, width: str, start: str | None = None, slice_seconds: int = BLOCK_SECONDS, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each bar, slice of time and value of the columns `by`: (by, bar_time, slice, sums, tops, low, open, close, run columns)."""
    keys = [*by, "bar_time", "slice"]
    order = Window.partitionBy(*keys).orderBy("ts", "record_num")
    t = ticks.select(*by, "ts", "record_num", "price", "txn_count", "direction", "level_low", "level_high", bar_time(width, start).alias("bar_time"), time_block("ts", slice_seconds).alias("slice"))
    turn = (~F.col("direction").eqNullSafe(F.lag("direction").over(order))).cast("int")
    t = t.withColumn("_turn", turn).withColumn("_island", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct("ts", "record_num")
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("txn_count")).otherwise(0))
    largest = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("txn_count"))), F.lit(0))
    runs = t.groupBy(*keys, "_island").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("txn_count").alias("volume"), F.count("price").alias("num_events"),
        side(1).alias("buy_volume"), side(-1).alias("sell_volume"), F.sum((F.col("level_high") - F.col("level_low") >= 2.0).cast("double")).alias("wide"), F.count(F.col("level_high") - F.col("level_low")).alias("spreads"),
        F.max("txn_count").alias("max_single_txn"), largest(1).alias("max_single_buy"), largest(-1).alias("max_single_sell"), F.sum(F.col("price") * F.col("txn_count")).alias("price_volume"),
        F.first("direction").alias("side"), F.count(F.lit(1)).alias("run"), F.min(at).alias("from_at"), F.max(at).alias("to_at"),
    )
    best = lambda d: F.coalesce(F.max(F.when(F.col("side") == d, F.col("run"))), F.lit(0)).cast("long")
    return runs.groupBy(*keys).agg(
        F.min_by("open", "from_at").alias("open"), F.min("low").alias("low"), F.max_by("close", "to_at").alias("close"), *(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in TOPS),
        F.min_by("side", "from_at").alias("first_side"), F.min_by("run", "from_at").alias("first_run"), F.max_by("side", "to_at").alias("last_side"), F.max_by("run", "to_at").alias("last_run"),
        best(1).alias("best_buy"), best(-1).alias("best_sell"), F.sum("run").alias("n"), F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"),
    )


def longest(parts: Column) -> Column:
    """(buy, sell): the longest runs of slices that are in order of time and don't overlap."""
    begin = F.struct(F.lit(None).cast("int").alias("side"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("buy"), F.lit(0).cast("long").alias("sell"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["side"].eqNullSafe(p["first_side"]), a["run"]).otherwise(F.lit(0)) + p["first_run"]
        one = p["first_run"] == p["n"]
        top = lambda d, own, best: F.greatest(own, best, F.when(p["first_side"] == d, joined).otherwise(F.lit(0)))
        return F.struct(
            F.when(one, p["first_side"]).otherwise(p["last_side"]).cast("int").alias("side"), F.when(one, joined).otherwise(p["last_run"]).cast("long").alias("run"),
            top(1, a["buy"], p["best_buy"]).cast("long").alias("buy"), top(-1, a["sell"], p["best_sell"]).cast("long").alias("sell"),
        )

    return F.aggregate(parts, begin, step, lambda a: F.struct(a["buy"].alias("buy"), a["sell"].alias("sell")))


def merged(parts: DataFrame, width: str) -> DataFrame:
    """Bars as time_bars gives them, and overlaps: whether slices of a bar overlap in time, of which runs can't be told without their ticks."""
    b = parts.groupBy("bar_time").agg(
        F.min_by("open", "from_at").alias("open"), F.min("low").alias("low"), F.max_by("close", "to_at").alias("close"), *(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in TOPS),
        F.sort_array(F.collect_list(F.struct(*RUN))).alias("_parts"),
    )
    crossed = F.exists(F.arrays_zip(F.slice("_parts", 1, F.size("_parts") - 1).alias("a"), F.slice("_parts", 2, F.size("_parts")).alias("b")), lambda x: x["a"]["to_at"] >= x["b"]["from_at"])
    b = b.withColumns({"_runs": longest(F.col("_parts")), "overlaps": (F.size("_parts") > 1) & crossed})
    out = ["bar_time", "open", "high", "low", "close", "volume", "num_events", "buy_volume", "sell_volume", F.try_divide("wide", "spreads").alias("wide_spread_frac"), "max_single_txn", "max_single_buy", "max_single_sell", "price_volume"]
    return with_ratios(b.select(*out, F.col("_runs.buy").alias("max_buy_run"), F.col("_runs.sell").alias("max_sell_run"), "overlaps"), width)


def sliced_bars(ticks: DataFrame, width: str, start: str | None = None, slice_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """What time_bars gives, with no task that holds more than a slice of a bar's ticks: for bars of hours and days."""
    return merged(partial_bars(ticks, width, start, slice_seconds), width).drop("overlaps")
