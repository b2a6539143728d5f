"""Live bars with keyed state: what a trigger costs follows its new ticks, and no history is read again.

State of an instrument, in the state store: the ticks of its open bars, its last `keep` closed bars, and the totals before those (number of bars, running
delta).  A bar closes when a tick `late` seconds behind its end has come, or, for an instrument that falls silent, by a timer when the watermark of
the whole stream has passed its end.  Its ticks go then, so state is bounded by the ticks of open bars and a fixed number of bars.

A trigger gives the kept bars, those that closed, and the open ones as they stand, numbered and with their running delta, so that features with a
look-back of `keep` bars or less come out as a batch over all ticks has them; `fresh` marks the bars that the trigger changed.

Defined cases
* Ticks of a closed bar are late and left out; ticks within `late` seconds are put in their place by time and record number.
* Instruments are apart from each other: order, bars and delta are each one's own.  A bar without ticks doesn't exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickforge.operators import bars as bar_operators
from tickforge.operators import features
from tickforge.operators.ordering import BLOCK
from tickforge.sources import scratch

TICK = "us long, record_num long, price double, level_low double, level_high double, txn_count long, direction int"
BAR = (
    "start long, bar_seq long, cvd long, open double, high double, low double, close double, volume long, num_events long, buy_volume long, sell_volume long, "
    "wide_spread_frac double, max_single_txn long, max_single_buy long, max_single_sell long, price_volume double, max_buy_run long, max_sell_run long"
)
_TICK, _BAR = ([c.split()[0] for c in x.split(", ")] for x in (TICK, BAR))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bars_of(ticks: pd.DataFrame, width: int) -> pd.DataFrame:
    """Bars of ticks by the start of their span of `width` microseconds; what time_bars says of each, but for what follows from it."""
    t = ticks.sort_values(["us", "record_num"])
    start = t["us"] // width * width
    side = t["direction"].to_numpy()
    buy, sell = (t["txn_count"].where(side == d) for d in (1, -1))
    spread = t["level_high"] - t["level_low"]
    turns = (t["direction"] != t["direction"].shift()) | (start != start.shift())
    run = t.groupby(turns.cumsum().to_numpy()).cumcount() + 1
    d = pd.DataFrame({
        "start": start, "price": t["price"], "n": t["txn_count"], "buy": buy, "sell": sell, "pv": t["price"] * t["txn_count"], "wide": (spread >= 2.0).astype(float).where(spread.notna()),
        "buy_run": run.where(side == 1, 0), "sell_run": run.where(side == -1, 0),
    })
    g = d.groupby("start", sort=True)
    out = pd.DataFrame({
        "open": g["price"].first(), "high": g["price"].max(), "low": g["price"].min(), "close": g["price"].last(), "volume": g["n"].sum(), "num_events": g["price"].count(), "buy_volume": g["buy"].sum(), "sell_volume": g["sell"].sum(),
        "wide_spread_frac": g["wide"].mean(), "max_single_txn": g["n"].max(), "max_single_buy": g["buy"].max().fillna(0), "max_single_sell": g["sell"].max().fillna(0), "price_volume": g["pv"].sum(),
        "max_buy_run": g["buy_run"].max(), "max_sell_run": g["sell_run"].max(),
    }).reset_index()
    return out.astype({c: np.int64 for c in ("start", "volume", "num_events", "buy_volume", "sell_volume", "max_single_txn", "max_single_buy", "max_single_sell", "max_buy_run", "max_sell_run")})


class Bars(StatefulProcessor):
    def __init__(self, width: int, late: int, keep: int):
        self.width, self.late, self.keep = width * 1_000_000, late * 1_000_000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", TICK)
        self.closed = handle.getListState("closed", BAR)
        #: Closed bars and their delta so far, and the end of the last one.
        self.totals = handle.getValueState("totals", "n long, cvd long, border long")

    def _advance(self, key: tuple, new: pd.DataFrame, border: int) -> pd.DataFrame:
        """Take in ticks, close the bars that end by `border`, and tell the bars."""
        n, cvd, last = self.totals.get() if self.totals.exists() else (0, 0, -(1 << 62))
        held = pd.DataFrame(list(self.ticks.get()) if self.ticks.exists() else [], columns=_TICK)
        old = pd.DataFrame(list(self.closed.get()) if self.closed.exists() else [], columns=_BAR)
        new = new[new["us"] >= last]
        ticks = pd.concat([x for x in (held, new) if len(x)] or [held], ignore_index=True)
        if not len(ticks):
            return pd.DataFrame(columns=[*_BAR, "closed", "fresh"])
        border = max(last, border, int(ticks["us"].max()) - self.late)
        b = bars_of(ticks, self.width)
        b["bar_seq"] = n + np.arange(len(b))
        b["cvd"] = cvd + (b["buy_volume"] - b["sell_volume"]).cumsum()
        b = b[_BAR]
        done = (b["start"] + self.width <= border).to_numpy()
        changed = set((new["us"] // self.width * self.width).tolist())
        told = pd.concat([x.assign(closed=c, fresh=f) for x, c, f in ((old, True, False), (b[done], True, True), (b[~done], False, b["start"][~done].isin(changed))) if len(x)], ignore_index=True)
        if done.any():
            end = b[done].iloc[-1]
            self.totals.update((int(n + done.sum()), int(end["cvd"]), int(end["start"] + self.width)))
            kept = b[done] if not len(old) else pd.concat([old, b[done]], ignore_index=True)
            self.closed.put([tuple(r) for r in kept.tail(self.keep).itertuples(index=False, name=None)])
            ticks = ticks[ticks["us"] >= end["start"] + self.width]
        if len(ticks):
            self.ticks.put(list(ticks[_TICK].itertuples(index=False, name=None)))
        elif self.ticks.exists():
            self.ticks.clear()
        for old_timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(old_timer[0] if isinstance(old_timer, tuple) else old_timer)
        if (~done).any():
            self.handle.registerTimer(int(b["start"][~done].iloc[0] + self.width) // 1000)
        return told

    def _rows(self, key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        told.insert(0, "instrument", key[0])
        return told

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[_TICK] for r in rows], ignore_index=True)
        told = self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)
        if len(told):
            yield self._rows(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = self._advance(key, pd.DataFrame(columns=_TICK).astype({"us": "int64"}), timerValues.getCurrentWatermarkInMs() * 1000)
        if len(told):
            yield self._rows(key, told)

    def close(self) -> None:
        pass


def live_bars(ticks: DataFrame, width: str = "1 minute", late: int = 60, keep: int = features.BACK, instrument: str | None = None) -> DataFrame:
    """(instrument, BAR's columns, closed, fresh) of streaming ticks; the watermark is `late` seconds."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.col("ts").cast("timestamp")
    t = ticks.select(
        (F.col(instrument).cast("string") if instrument else F.lit("")).alias("instrument"), at.alias("event_time"), F.unix_micros(at).alias("us"),
        *(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in TICK.split(", ")[1:])),
    )
    t = t.withWatermark("event_time", f"{late} seconds")
    return t.groupBy("instrument").transformWithStateInPandas(Bars(bar_operators.seconds(width), late, keep), f"instrument string, {BAR}, closed boolean, fresh boolean", "update", "eventTime")


def as_bars(told: DataFrame, width: str) -> DataFrame:
    """Bars as time_bars and sequence give them, of all instruments: instrument, true_seq, closed and fresh beside them.

    bar_seq puts each instrument in blocks of its own with a gap before, so no look-back reaches from one into another.
    """
    # A closing timer and new ticks can both tell of a bar in one trigger: the closed one counts.
    best = F.max_by(F.struct(*told.columns), F.struct("closed", "fresh", "num_events"))
    own = told.groupBy("instrument", "bar_seq").agg(best.alias("b")).select("b.*").withColumnRenamed("bar_seq", "true_seq")
    each = own.groupBy("instrument").agg(F.min("true_seq").alias("_first"), (F.max("true_seq") - F.min("true_seq")).alias("_span"))
    # A row an instrument.
    each = each.withColumn("_at", F.coalesce(F.sum(F.floor(F.col("_span") / BLOCK) + 2).over(Window.orderBy("instrument").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * BLOCK + BLOCK // 2)
    b = own.join(each.withColumnRenamed("instrument", "_i"), F.col("instrument") == F.col("_i"))
    b = b.withColumns({"bar_seq": F.col("_at") + F.col("true_seq") - F.col("_first"), "bar_time": F.timestamp_micros("start").cast("timestamp_ntz")})
    return bar_operators.with_ratios(b.drop("start", "_i", "_at", "_first", "_span"), width)


def watch(ticks: DataFrame, signal: Callable[[DataFrame], DataFrame], checkpoint: str, out: str, width: str = "1 minute", late: int = 60, keep: int = features.BACK, instrument: str | None = None, newest: bool = False, trigger: str = "5 seconds", once: bool = False):
    """Give each trigger's bars to `signal`; what it says of fresh bars, or of each instrument's newest alone, goes to out by trigger and day.

    A trigger that is run again after a failure replaces its own part.  What is written on the way is deleted with the trigger.
    """

    def step(batch: DataFrame, number: int) -> None:
        with scratch.scope(batch.sparkSession):
            told = scratch.written(batch, "live-told")
            if told.isEmpty():
                return
            b = scratch.written(as_bars(told, width), "live-bars")
            of = b.where("fresh").select("bar_seq", "instrument", "true_seq", "closed")
            said = signal(b.drop("instrument", "true_seq", "closed", "fresh")).join(of, "bar_seq").withColumn("bar_seq", F.col("true_seq")).drop("true_seq")
            if newest:
                said = said.groupBy("instrument").agg(F.max_by(F.struct(*said.columns), "bar_time").alias("s")).select("s.*")
            said.withColumn("day", F.to_date("bar_time")).coalesce(1).write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")

    writer = live_bars(ticks, width, late, keep, instrument).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
