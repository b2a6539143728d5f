"""Labels that look ahead: forward returns and first-touch barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.market import is_rth

from .features import BACK, atr, stop_distance, true_range
from .ordering import margin_window, own_rows, with_margin

MAX_HOLD = 60


def forward_labels(bars: DataFrame, ahead: int) -> DataFrame:
    """future_close, future_return, magnitude_label and direction_label, `ahead` bars on."""
    d = with_margin(bars, "bar_seq", 0, ahead).withColumn("future_close", F.lead("close", ahead).over(margin_window()))
    gain = F.col("future_close") - F.col("close")
    return own_rows(d.withColumns({"future_return": F.try_divide(gain, F.col("close")), "magnitude_label": F.abs(gain), "direction_label": F.signum(gain)}))


def bars_ahead(bars: DataFrame, horizon_seconds: int) -> int:
    """A horizon in bars: the whole part of its share of the median gap between bars, at least one."""
    d = with_margin(bars.select("bar_seq", "bar_time"), "bar_seq", 1)
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    gaps = own_rows(d.withColumn("gap", at(F.col("bar_time")) - at(F.lag("bar_time").over(margin_window()))))
    gap = gaps.agg(F.median("gap")).first()[0]
    return max(1, int(horizon_seconds * 1_000_000 / gap)) if gap else 1


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Per direction: count and share; magnitude's mean, sample deviation and median."""
    per = labelled.where(F.col("direction_label").isNotNull()).groupBy("direction_label").agg(F.count(F.lit(1)).alias("n"), F.avg("magnitude_label").alias("mean_magnitude"), F.stddev_samp("magnitude_label").alias("std_magnitude"), F.median("magnitude_label").alias("median_magnitude"))
    return per.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def barrier(path: Column, entry: Column, stop: Column, target: Column, side: int) -> Column:
    """Fold the bars after the entry: (done, result, held, mae, mfe).  The stop is tested before the target,
    and the bar of the exit still counts for the excursions."""
    state = F.struct(F.lit(False).alias("done"), F.lit(0).alias("result"), F.lit(0).alias("held"), F.lit(0.0).alias("mae"), F.lit(0.0).alias("mfe"))

    def step(a: Column, bar: Column) -> Column:
        good, bad = (bar["high"] - entry, entry - bar["low"]) if side > 0 else (entry - bar["low"], bar["high"] - entry)
        # Prices are compared, not distances, as rounding could tell them apart.
        lost = bar["low"] <= entry - stop if side > 0 else bar["high"] >= entry + stop
        won = bar["high"] >= entry + target if side > 0 else bar["low"] <= entry - target
        new = F.struct(
            (lost | won).alias("done"),
            F.when(lost, -1).when(won, 1).otherwise(0).alias("result"),
            (a["held"] + 1).alias("held"),
            F.greatest(a["mae"], bad).alias("mae"),
            F.greatest(a["mfe"], good).alias("mfe"),
        )
        return F.when(a["done"], a).otherwise(new)

    return F.aggregate(path, state, step)


def triple_barrier(bars: DataFrame, rr: float = 1.5, max_hold: int = MAX_HOLD) -> DataFrame:
    """bars with sl_points, tp_points and the outcome of a long and a short entered at each close."""
    d = with_margin(bars, "bar_seq", BACK, max_hold).withColumns(true_range()).withColumns(atr(14))
    d = d.withColumn("sl_points", stop_distance()).withColumn("tp_points", F.col("sl_points") * rr)
    d = own_rows(d.withColumn("_path", F.collect_list(F.struct("high", "low")).over(margin_window().rowsBetween(1, max_hold)))).drop("_tr")
    for name, side in (("long", 1), ("short", -1)):
        d = d.withColumn("_x", barrier(F.col("_path"), F.col("close"), F.col("sl_points"), F.col("tp_points"), side)).withColumns({
            f"{name}_result": F.col("_x.result"),
            f"{name}_bars_held": F.when(F.col("_x.done"), F.col("_x.held")).otherwise(max_hold),
            f"{name}_mae": F.col("_x.mae").cast("float"),
            f"{name}_mfe": F.col("_x.mfe").cast("float"),
        })
    return d.drop("_x", "_path")


def trade_labels(outcomes: DataFrame) -> DataFrame:
    """trade_label: the side that wins; of two, the faster, a tie being long."""
    long, short = F.col("long_result") == 1, F.col("short_result") == 1
    faster = F.when(F.col("long_bars_held") <= F.col("short_bars_held"), 1).otherwise(-1)
    label = F.when(long & short, faster).when(long, 1).when(short, -1).otherwise(0)
    d = outcomes.withColumn("trade_label", label).withColumn("is_rth", is_rth(F.col("bar_time")))
    settled = (F.col("long_result") != 0) | (F.col("short_result") != 0)
    return d.withColumns({"has_trade_outcome": settled.cast("int"), "quality_label": (long | short).cast("int")})


def atr_target(bars: DataFrame, ahead: int = 5) -> DataFrame:
    """The 5-bar ATR as it will be `ahead` bars on."""
    d = with_margin(bars, "bar_seq", BACK, ahead).withColumns(true_range()).withColumns(atr(5))
    return own_rows(d.withColumn("atr_target", F.lead("atr_5", ahead).over(margin_window()))).drop("_tr")
