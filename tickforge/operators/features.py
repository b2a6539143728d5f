"""Rolling features of bars, as lists of named expressions over one window specification, so that they share one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.market import TICK_SIZE, at_least, clip, round_to_tick, safe_divide, time_features

from .ordering import margin_window, own_rows, prefix_sums, with_margin

#: The longest look-back is a mean of 20 over values that look 14 back themselves.
BACK = 64
LOOKBACKS = (3, 5, 10)


def full(agg, x: str, n: int) -> Column:
    """agg over the last n rows, NULL unless all n have a value."""
    w = margin_window().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def part(agg, x: str, n: int) -> Column:
    """agg over the last n rows or as many as there are."""
    return agg(x).over(margin_window().rowsBetween(1 - n, 0))


def change(x: str, n: int) -> Column:
    return safe_divide(F.col(x), F.lag(x, n).over(margin_window())) - 1


def difference(x: str, n: int) -> Column:
    return F.col(x) - F.lag(x, n).over(margin_window())


def returns() -> dict[str, Column]:
    return {"return_1": change("close", 1)}


def rolling(lookbacks=LOOKBACKS) -> dict[str, Column]:
    out = {}
    for n in lookbacks:
        out |= {
            f"roll_{n}_momentum": change("close", n),
            f"roll_{n}_volatility": full(F.stddev_samp, "return_1", n),
            f"roll_{n}_flow_imb": full(F.avg, "flow_imbalance", n),
            f"roll_{n}_intensity": full(F.avg, "intensity", n),
            f"roll_{n}_vol_ratio": safe_divide(F.col("volume").cast("double"), full(F.avg, "volume", n)),
        }
    return out


def true_range() -> dict[str, Column]:
    last = F.lag("close").over(margin_window())
    return {"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))}


def atr(*periods: int) -> dict[str, Column]:
    return {f"atr_{n}": part(F.avg, "_tr", n) for n in periods}


def stop_distance(multiplier: float = 1.5, low: float = 2.0, high: float = 8.0) -> Column:
    return round_to_tick(clip(F.col("atr_14") * multiplier, low, high))


def micro_first() -> dict[str, Column]:
    bar_range = F.col("high") - F.col("low")
    delta = F.col("buy_volume") - F.col("sell_volume")
    return {
        "delta": delta,
        "price_direction": F.signum(F.col("close") - F.col("open")),
        "delta_direction": F.signum(delta.cast("double")),
        "bar_range": bar_range,
        "vol_per_tick": F.col("volume") / at_least(bar_range / TICK_SIZE, 1.0),
    }


def micro_second() -> dict[str, Column]:
    unit = at_least(F.col("atr_14"), TICK_SIZE)
    ma = lambda x, n: full(F.avg, x, n)
    above, below = full(F.max, "high", 20) - F.col("close"), F.col("close") - full(F.min, "low", 20)
    out = {
        "delta_divergence": (F.col("price_direction") != F.col("delta_direction")).cast("int"),
        "absorption": safe_divide(F.col("vol_per_tick"), part(F.avg, "vol_per_tick", 20)),
        "large_trade_ratio": F.col("max_single_txn") / at_least(F.col("volume").cast("double"), 1.0),
        "atr_ratio": F.col("atr_5") / unit,
        "range_vs_atr": F.col("bar_range") / unit,
        "close_position": (F.col("close") - F.col("low")) / at_least(F.col("bar_range"), TICK_SIZE),
        "vwap_distance": (F.col("close") - F.col("vwap")) / unit,
        "swing_high_dist": above,
        "swing_low_dist": below,
        "swing_range_pct": below / at_least(above + below, TICK_SIZE),
        "range_ma_5": ma("bar_range", 5),
        "range_ma_20": ma("bar_range", 20),
        "consolidation": ma("bar_range", 5) / at_least(ma("bar_range", 20), TICK_SIZE),
        "flow_accel": difference("flow_imbalance", 1),
        "flow_accel_3": difference("flow_imbalance", 3),
        "vol_ma_20": ma("volume", 20),
        "vol_surge": F.col("volume") / at_least(ma("volume", 20), 1.0),
        "ma_cross_5_20": (ma("close", 5) - ma("close", 20)) / unit,
        "gap": F.col("open") - F.lag("close").over(margin_window()),
        "gap_atr": (F.col("open") - F.lag("close").over(margin_window())) / unit,
    }
    return out | {f"roc_{n}": change("close", n) for n in LOOKBACKS} | {f"close_{n}bar_ma": ma("close", n) for n in (5, 10, 20)} | {f"cvd_slope_{n}": difference("cvd", n) / n for n in LOOKBACKS}


def multi_timeframe(frames=(5, 15)) -> dict[str, Column]:
    out = {}
    for n in frames:
        high, low = full(F.max, "high", n), full(F.min, "low", n)
        out |= {
            f"tf{n}_high": high,
            f"tf{n}_low": low,
            f"tf{n}_range": high - low,
            f"tf{n}_close_pos": (F.col("close") - low) / at_least(high - low, TICK_SIZE),
            f"tf{n}_delta_sum": full(F.sum, "delta", n),
            f"tf{n}_vol_sum": full(F.sum, "volume", n),
            f"tf{n}_imbalance": full(F.avg, "flow_imbalance", n),
        }
    return out


def add_cvd(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with cvd, the running delta of all bars, each instrument's by itself."""
    return prefix_sums(bars, F.to_date("bar_time"), ["bar_time"], {"cvd": F.col("buy_volume") - F.col("sell_volume")}, by)


def first_generation(bars: DataFrame) -> DataFrame:
    """bars (with bar_seq) with the 16 rolling and 5 time features."""
    d = with_margin(bars, "bar_seq", BACK).withColumns(returns()).withColumns(rolling())
    return own_rows(d).withColumns(time_features(F.col("bar_time")))


def second_generation(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """And the 37 microstructure and 14 multi-timeframe features.  A cvd that bars have already, as live ones do, is taken."""
    d = with_margin(bars if "cvd" in bars.columns else add_cvd(bars, by), "bar_seq", BACK).withColumns(returns()).withColumns(rolling())
    d = d.withColumns(true_range()).withColumns(atr(5, 14) | micro_first()).withColumns(micro_second() | multi_timeframe())
    return own_rows(d).drop("_tr").withColumns(time_features(F.col("bar_time")))
