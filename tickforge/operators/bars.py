"""Time bars and what they are made of: order flow, runs, cumulative delta, footprints.

The columns `by` name the instrument, if ticks have several; each has bars of its own, in one pass for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.market import TICK_SIZE, safe_divide

from .ordering import BLOCK_RECORDS, in_lanes, numbered, prefix_sums, time_block


def seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def bar_time(width: str, start: str | None = None) -> Column:
    """The start of the tick's bar.  start shifts the grid, for widths that don't divide a day."""
    return (F.window("ts", width, width, start) if start else F.window("ts", width))["start"]


def anchor(ticks: DataFrame, width: str) -> str | None:
    """Where the grid of bars starts so that one starts at the midnight of the first day; None for widths that divide a day."""
    n = seconds(width)
    if 86_400 % n == 0:
        return None
    first = ticks.agg(F.unix_seconds(F.min(F.date_trunc("day", "ts")).cast("timestamp")).alias("s")).first()["s"]
    return f"{(first or 0) % n} seconds"


def _islands(ticks: DataFrame, width: str, start: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """ticks with bar_time and island, a number that each run of a direction has in its bar: one sort within bars."""
    order = Window.partitionBy(*by, "bar_time").orderBy("ts", "record_num")
    t = ticks.withColumn("bar_time", bar_time(width, start))
    turns = ~F.col("direction").eqNullSafe(F.lag("direction").over(order))
    return t.withColumn("_turn", turns.cast("int")).withColumn("island", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_turn")


def _longest(d: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("direction") == d, F.col("run"))), F.lit(0)).cast("long")


def longest_runs(ticks: DataFrame, width: str, start: str | None = None) -> DataFrame:
    """(bar_time, max_buy_run, max_sell_run): gaps and islands within each bar."""
    t = _islands(ticks.select("ts", "record_num", "direction"), width, start)
    runs = t.groupBy("bar_time", "island").agg(F.first("direction").alias("direction"), F.count(F.lit(1)).alias("run"))
    return runs.groupBy("bar_time").agg(_longest(1).alias("max_buy_run"), _longest(-1).alias("max_sell_run"))


def time_bars(ticks: DataFrame, width: str = "1 minute", runs: bool = True, start: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A bar for each bucket that has ticks, labelled by its start.

    Open and close go by (ts, record_num), which makes them definite; all else is sums.  Without runs, partial sums are
    shuffled; runs need the ticks of a bar in order, and then all else is summed from the runs, in the same tasks.
    """
    at = F.struct("ts", "record_num")
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("txn_count")).otherwise(0))
    largest = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("txn_count"))), F.lit(0))
    keys = [*by, "bar_time"]
    if runs:
        t = _islands(ticks.select(*by, "ts", "record_num", "price", "txn_count", "direction", "level_low", "level_high"), width, start, by)
        keys += ["island"]
    else:
        t = ticks.withColumn("bar_time", bar_time(width, start))
    bars = t.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("txn_count").alias("volume"),
        F.count("price").alias("num_events"),
        side(1).alias("buy_volume"),
        side(-1).alias("sell_volume"),
        F.sum((F.col("level_high") - F.col("level_low") >= 2.0).cast("double")).alias("_wide"),
        F.count(F.col("level_high") - F.col("level_low")).alias("_spreads"),
        F.max("txn_count").alias("max_single_txn"),
        largest(1).alias("max_single_buy"),
        largest(-1).alias("max_single_sell"),
        F.sum(F.col("price") * F.col("txn_count")).alias("price_volume"),
        *((F.first("direction").alias("direction"), F.count(F.lit(1)).alias("run"), F.min(at).alias("_from"), F.max(at).alias("_to")) if runs else ()),
    )
    if runs:
        total = lambda *names: [F.sum(n).alias(n) for n in names]
        top = lambda *names: [F.max(n).alias(n) for n in names]
        bars = bars.groupBy(*by, "bar_time").agg(
            F.min_by("open", "_from").alias("open"), *top("high"), F.min("low").alias("low"), F.max_by("close", "_to").alias("close"), *total("volume", "num_events", "buy_volume", "sell_volume", "_wide", "_spreads"),
            *top("max_single_txn", "max_single_buy", "max_single_sell"), *total("price_volume"), _longest(1).alias("max_buy_run"), _longest(-1).alias("max_sell_run"),
        )
    out = [*by, "bar_time", "open", "high", "low", "close", "volume", "num_events", "buy_volume", "sell_volume", F.try_divide("_wide", "_spreads").alias("wide_spread_frac"), "max_single_txn", "max_single_buy", "max_single_sell", "price_volume"]
    return with_ratios(bars.select(*out, *(["max_buy_run", "max_sell_run"] if runs else [])), width)


def with_ratios(bars: DataFrame, width: str) -> DataFrame:
    """bars with what follows from their sums."""
    return bars.withColumns({
        "flow_imbalance": safe_divide((F.col("buy_volume") - F.col("sell_volume")).cast("double"), F.col("volume").cast("double")),
        "intensity": F.col("num_events") / F.lit(float(seconds(width))),
        "vwap": safe_divide(F.col("price_volume"), F.col("volume").cast("double")),
    })


def bar_shape(bars: DataFrame, tick: float = TICK_SIZE) -> DataFrame:
    return bars.withColumns({"range_ticks": (F.col("high") - F.col("low")) / tick, "body_ticks": (F.col("close") - F.col("open")) / tick})


def sequence(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with bar_seq from 0, numbered day by day; of several instruments each has a lane of numbers, from a multiple of LANE."""
    d = numbered(bars, F.to_date("bar_time"), ["bar_time"], "bar_seq", by)
    return in_lanes(d, "bar_seq", by) if by else d


def session_cvd(ticks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ticks with cumulative_volume_delta, which restarts with each file and session."""
    block = F.floor(F.col("record_num") / BLOCK_RECORDS)
    return prefix_sums(ticks, block, ["record_num"], {"cumulative_volume_delta": F.col("volume_delta")}, [*by, "source_file", "session_date"])


def cvd_bars(ticks: DataFrame, width: str, start: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Bars of the session's cumulative delta, with the price bar's up flag."""
    at, cvd = F.struct("ts", "record_num"), "cumulative_volume_delta"
    return session_cvd(ticks, by).groupBy(*by, bar_time(width, start).alias("bar_time")).agg(
        F.min_by(cvd, at).alias("cvd_open"), F.max(cvd).alias("cvd_high"), F.min(cvd).alias("cvd_low"), F.max_by(cvd, at).alias("cvd_close"), (F.max_by("price", at) >= F.min_by("price", at)).alias("up")
    )


def cvd_candles(ticks: DataFrame, width: str) -> DataFrame:
    """Candles of a cumulative delta that never restarts; a candle opens where the one before closed."""
    run = prefix_sums(ticks, time_block("ts"), ["ts", "record_num"], {"cvd": F.col("volume_delta")})
    at = F.struct("ts", "record_num")
    c = run.groupBy(bar_time(width).alias("bar_time")).agg(F.max("cvd").alias("high"), F.min("cvd").alias("low"), F.max_by("cvd", at).alias("cvd_close"), (F.min_by("cvd", at) - F.min_by("volume_delta", at)).alias("cvd_open"))
    return c.select("bar_time", "cvd_open", F.greatest("cvd_open", "high").alias("cvd_high"), F.least("cvd_open", "low").alias("cvd_low"), "cvd_close")


def cvd_candles_of_bars(bars: DataFrame) -> DataFrame:
    """The same from bars alone, which know only where each ends."""
    b = prefix_sums(bars, F.to_date("bar_time"), ["bar_time"], {"cvd_close": F.col("buy_volume") - F.col("sell_volume")})
    opened = F.col("cvd_close") - F.col("buy_volume") + F.col("sell_volume")
    return b.select("bar_time", opened.alias("cvd_open"), F.greatest(opened, "cvd_close").alias("cvd_high"), F.least(opened, "cvd_close").alias("cvd_low"), "cvd_close")


def footprint(ticks: DataFrame, width: str, known_only: bool = True, start: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(bar_time, price, buy, sell), after the columns `by`; levels without a buy or sale go if known_only."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("txn_count")).otherwise(0))
    f = ticks.groupBy(*by, bar_time(width, start).alias("bar_time"), "price").agg(side(1).alias("buy"), side(-1).alias("sell"))
    return f.where((F.col("buy") > 0) | (F.col("sell") > 0)) if known_only else f


def diagonal_imbalance(levels: DataFrame, ratio: int = 3, tick: float = TICK_SIZE, by: Sequence[str] = ()) -> DataFrame:
    """Levels with flags: buys against the sales a tick below, sales against the buys a tick above."""
    w = Window.partitionBy(*by, "bar_time").orderBy("price")
    below = F.when(F.lag("price").over(w) == F.col("price") - tick, F.lag("sell").over(w))
    above = F.when(F.lead("price").over(w) == F.col("price") + tick, F.lead("buy").over(w))
    flag = lambda own, other: F.coalesce((other > 0) & (own >= ratio * other), F.lit(False))
    return levels.withColumns({"buy_imbalance": flag(F.col("buy"), below), "sell_imbalance": flag(F.col("sell"), above), "net": F.col("buy") - F.col("sell")})


def level_at(bars: DataFrame, levels: DataFrame, price: str = "close") -> DataFrame:
    """bars with the volumes of the level that they have at a price: a bar's footprint looked up by its time, then its price."""
    f = levels.select(F.col("bar_time").alias("_bt"), F.col("price").alias("_p"), F.col("buy").alias("level_buy"), F.col("sell").alias("level_sell"))
    return bars.join(f, (F.col("bar_time") == F.col("_bt")) & (F.col(price) == F.col("_p")), "left").drop("_bt", "_p")


def level_scale(levels: DataFrame) -> DataFrame:
    """(bar_time, max_level): the largest side of a level, at least 1."""
    return levels.groupBy("bar_time").agg(F.greatest(F.max(F.greatest("buy", "sell")), F.lit(1)).alias("max_level"))


def tick_summary(ticks: DataFrame) -> DataFrame:
    """One row a file; an empty file has none."""
    share = lambda d: F.count_if(F.col("direction") == d) * 100.0 / F.count(F.lit(1))
    return session_cvd(ticks).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("txn_count").alias("total_txn"),
        F.max("txn_count").alias("max_txn"), F.count_if(F.col("direction") == 1).alias("n_buy"), F.count_if(F.col("direction") == -1).alias("n_sell"), share(1).alias("pct_buy"), share(-1).alias("pct_sell"), F.max_by("cumulative_volume_delta", "record_num").alias("last_cvd"),
    )


def bar_summary(bars: DataFrame) -> DataFrame:
    change = F.col("close") - F.col("open")
    return bars.agg(
        F.count(F.lit(1)).alias("n"), F.min("bar_time").alias("first_bar"), F.max("bar_time").alias("last_bar"), F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.sum("volume").alias("total_volume"), F.sum("buy_volume").alias("total_buy"), F.sum("sell_volume").alias("total_sell"),
        F.count_if(change > 1e-9).alias("n_up"), F.count_if(change < -1e-9).alias("n_down"), F.count_if(F.abs(change) <= 1e-9).alias("n_flat"),
    )
