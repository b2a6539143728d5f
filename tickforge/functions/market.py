"""Scalar expressions of the tick and bar model.  NULL stands for what isn't defined; NaN is never made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK_SIZE, POINT_VALUE = 0.25, 50.0
SLIPPAGE_TICKS, COMMISSION = 1, 2.50
SESSION_RESET_HOUR = 18


def safe_divide(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def at_least(x: Column, low: float) -> Column:
    """Lower clip that leaves NULL alone (greatest skips it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def round_to_tick(x: Column, tick: float = TICK_SIZE) -> Column:
    """Half to even."""
    return F.rint(x / tick) * tick


def direction(price: Column, low: Column, high: Column) -> Column:
    """Quote rule: at the upper bound a buy, at the lower a sale, else unknown; a buy wins."""
    return F.when(F.abs(price - high) < 1e-9, 1).when(F.abs(price - low) < 1e-9, -1).otherwise(0)


def direction_name(d: Column) -> Column:
    return F.when(d == 1, "BUY").when(d == -1, "SELL").otherwise("UNKNOWN")


def session_date(ts: Column, reset_hour: int = SESSION_RESET_HOUR) -> Column:
    """The day of a session that starts at reset_hour of the clock."""
    return F.to_date(ts - F.expr(f"INTERVAL {reset_hour} HOURS"))


def new_york(ts: Column) -> Column:
    """A naive time read as UTC, as New York's clock shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def is_rth(ts: Column) -> Column:
    """9:30 to 15:30 in New York."""
    clock = F.hour(new_york(ts)) * 100 + F.minute(new_york(ts))
    return (clock >= 930) & (clock < 1530)


def is_session_end(ts: Column) -> Column:
    return (F.hour(new_york(ts)) == 15) & (F.minute(new_york(ts)) >= 25)


def time_features(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    turn = 2 * F.pi() * (hour + F.minute(ts) / F.lit(60.0)) / 24
    flag = lambda c: c.cast("int")
    return {"hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "session_asia": flag((hour >= 1) & (hour < 9)), "session_europe": flag((hour >= 9) & (hour < 16)), "session_us": flag((hour >= 16) | (hour < 1))}


def change_class(open_: Column, close: Column, tolerance: float = 1e-9) -> Column:
    return F.when(close - open_ > tolerance, "up").when(close - open_ < -tolerance, "down").otherwise("flat")


def trade_result(pnl: Column) -> Column:
    return F.when(pnl > 0, "WIN").when(pnl < 0, "LOSS").otherwise("SCRATCH")


def volume_label(v: Column) -> Column:
    """1234 as 1.2K: the double's own value is rounded and halves go to even, as C's printf does.  Java's goes by the number as printed, halves up."""
    return F.when(v >= 1000, F.concat(F.call_function("format_number", v / F.lit(1000.0), F.lit("0.0")), F.lit("K"))).otherwise(v.cast("string"))


def dotnet_ticks(ts: Column) -> Column:
    """100 ns since 0001-01-01, from a naive time."""
    return F.unix_micros(ts.cast("timestamp")) * 10 + 621_355_968_000_000_000


def from_dotnet_ticks(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor(ticks / 10).cast("long") - 62_135_596_800_000_000).cast("timestamp_ntz")


def prediction(prob_up: Column, magnitude: Column, least_confidence: float = 0.3) -> dict[str, Column]:
    """What a probability of rising means for a trader."""
    up = prob_up > 0.5
    side = F.when(up, "UP").otherwise("DOWN")
    confidence = F.abs(prob_up - 0.5) * 2
    return {
        "prob_down": 1 - prob_up,
        "direction_pred": side,
        "confidence": confidence,
        "signal_strength": confidence * F.when(up, magnitude).otherwise(-magnitude),
        "signal": F.when(confidence > least_confidence, side).otherwise("HOLD"),
    }
