"""Consolidation, breakout, retracement: the pattern scan as a relational pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.market import TICK_SIZE, clip
from tickforge.sources.scratch import written

from .asof import asof_join
from .bars import bar_time, seconds
from .chain import greedy_chain
from .ordering import margin_window, numbered, own_rows, time_block, with_margin


def consolidation_zones(bars: DataFrame, min_bars: int = 5, max_bars: int = 10, min_volume: float = 2000) -> DataFrame:
    """(zone_id, start_seq, end_seq): greedy runs of bars whose mean volume holds for each length on the way."""
    w = margin_window()
    d = with_margin(bars.select("bar_seq", "volume"), "bar_seq", 0, max_bars)
    holds = lambda n: (F.count("volume").over(w.rowsBetween(0, n - 1)) == n) & (F.avg("volume").over(w.rowsBetween(0, n - 1)) >= min_volume)
    d = d.withColumns({f"_ok{n}": holds(n) for n in range(min_bars, max_bars + 1)})
    best, all_ok = F.lit(0), F.lit(True)
    for n in range(min_bars, max_bars + 1):
        all_ok = all_ok & F.col(f"_ok{n}")
        best = F.when(all_ok, n).otherwise(best)
    d = own_rows(d.withColumn("length", best)).where("length > 0").select("bar_seq", "length", (F.col("bar_seq") + F.col("length")).alias("next_free"))
    z = greedy_chain(d, "bar_seq", "next_free")
    return z.select(F.col("bar_seq").alias("zone_id"), F.col("bar_seq").alias("start_seq"), (F.col("next_free") - 1).alias("end_seq"))


def zone_bars(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """The bars of each zone, by an equality join on bar numbers."""
    z = zones.select("zone_id", F.explode(F.sequence("start_seq", "end_seq")).alias("_s"))
    return z.join(bars, F.col("_s") == F.col("bar_seq")).drop("_s")


def zone_summary(zones: DataFrame, bars: DataFrame) -> DataFrame:
    buy, sell = F.max("max_single_buy"), F.max("max_single_sell")
    return zone_bars(zones, bars).groupBy("zone_id").agg(
        F.min("bar_time").alias("consol_start"), F.max("bar_time").alias("last_bar"), F.count(F.lit(1)).alias("consol_bars"), F.max("high").alias("consol_high"), F.min("low").alias("consol_low"),
        ((F.max("high") - F.min("low")) / TICK_SIZE).alias("consol_range_ticks"), F.avg("volume").alias("consol_avg_vol"), buy.alias("max_single_buy_pre"), sell.alias("max_single_sell_pre"),
        F.when(buy >= sell, "BUY").otherwise("SELL").alias("dominant_side_pre"), F.greatest(buy, sell).alias("dominant_strength_pre"),
    )


def volume_profile(zones: DataFrame, bars: DataFrame, ticks: DataFrame, width: str) -> DataFrame:
    """(zone_id, price, buy_vol, sell_vol, total_vol): zones are whole bars, so ticks join on their bar."""
    z = zone_bars(zones, bars).select("zone_id", "bar_time")
    t = ticks.select(bar_time(width).alias("bar_time"), "price", "direction", "txn_count")
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("txn_count")).otherwise(0))
    return t.join(z, "bar_time").groupBy("zone_id", "price").agg(side(1).alias("buy_vol"), side(-1).alias("sell_vol"), F.sum("txn_count").alias("total_vol"))


def profile_metrics(profile: DataFrame, summary: DataFrame) -> DataFrame:
    """(zone_id, balance, poc_price, poc_centrality)."""
    mid = (F.col("consol_low") + F.col("consol_high")) / 2
    p = profile.join(summary.select("zone_id", "consol_low", "consol_high"), "zone_id").withColumn("mid", mid)
    half = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_vol"))), F.lit(0))
    top, bottom = half(F.col("price") >= F.col("mid")), half(F.col("price") < F.col("mid"))
    m = p.groupBy("zone_id").agg(top.alias("top"), bottom.alias("bottom"), F.max_by("price", F.struct("total_vol", -F.col("price"))).alias("poc_price"), F.first("mid").alias("mid"), F.first((F.col("consol_high") - F.col("consol_low")) / 2).alias("half"))
    flat = F.col("half") <= 0
    balance = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.least("top", "bottom").cast("double"), F.greatest("top", "bottom").cast("double")), F.lit(0.0)))
    poc = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(F.col("poc_price") - F.col("mid")), F.col("half"))))
    return m.select("zone_id", balance.alias("balance"), "poc_price", poc.alias("poc_centrality"))


def level_class(profile: DataFrame, levels: DataFrame) -> DataFrame:
    """(zone_id, level_type) for one level (zone_id, at) a zone: the nearest price's volume against the profile's median."""
    p = profile.join(levels, "zone_id")
    near = F.min_by(F.struct("buy_vol", "sell_vol", "total_vol"), F.struct(F.abs(F.col("price") - F.col("at")), F.col("price")))
    m = p.groupBy("zone_id").agg(near.alias("n"), F.median("total_vol").alias("median"))
    both = F.col("n.buy_vol") + F.col("n.sell_vol")
    one_sided = F.try_divide(F.greatest("n.buy_vol", "n.sell_vol").cast("double"), both.cast("double")) > 0.65
    return m.select("zone_id", F.when(F.col("n.total_vol") < F.col("median") * 0.5, "low_activity").when(one_sided, "high_one_sided").otherwise("neutral").alias("level_type"))


def breakouts(zones: DataFrame, bars: DataFrame, min_body: float = 4) -> DataFrame:
    """Zones whose next bar closes outside of their range with a body of at least min_body ticks."""
    s = zone_summary(zones, bars)
    b = bars.select(F.col("bar_seq").alias("bo_seq"), F.col("bar_time").alias("breakout_time"), F.col("open").alias("bo_open"), F.col("close").alias("breakout_close"), F.col("volume").alias("breakout_volume"), F.col("flow_imbalance").alias("breakout_imbalance"), F.col("vwap").alias("bo_vwap"))
    d = s.join(zones, "zone_id").join(b, F.col("end_seq") + 1 == F.col("bo_seq"))
    side = F.when(F.col("breakout_close") > F.col("consol_high"), "UP").when(F.col("breakout_close") < F.col("consol_low"), "DOWN")
    d = d.withColumns({"breakout_direction": side, "breakout_body_ticks": F.abs(F.col("breakout_close") - F.col("bo_open")) / TICK_SIZE})
    d = d.where(F.col("breakout_direction").isNotNull() & (F.col("breakout_body_ticks") >= min_body))
    edge = F.when(F.col("breakout_direction") == "UP", F.col("consol_high")).otherwise(F.col("consol_low"))
    span = F.col("breakout_close") - edge
    return d.withColumn("breakout_vwap_position", F.when(F.abs(span) < 1e-9, 0.5).otherwise(clip(F.try_divide(F.col("bo_vwap") - edge, span), 0.0, 1.0)))


def retracements(found: DataFrame, bars: DataFrame, max_bars: int = 5, min_pct: float = 0.5) -> DataFrame:
    """The first length of 1..max_bars at which the running extreme has come back far enough.  The measure is
    the far side of the zone, so it may exceed 1."""
    w = found.select("zone_id", "breakout_direction", "breakout_close", "consol_high", "consol_low", "bo_seq", F.posexplode(F.sequence(F.col("bo_seq") + 1, F.col("bo_seq") + max_bars)).alias("_r", "_s"))
    b = w.join(bars.select("bar_seq", "bar_time", "high", "low", "buy_volume", "sell_volume"), F.col("_s") == F.col("bar_seq"))
    path = F.sort_array(F.collect_list(F.struct("bar_seq", "bar_time", "high", "low", "buy_volume", "sell_volume")))
    g = b.groupBy("zone_id", "breakout_direction", "breakout_close", "consol_high", "consol_low").agg(path.alias("path"))
    g = g.select("*", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("retrace_bars"))
    part = F.slice("path", 1, F.col("retrace_bars"))
    up = F.col("breakout_direction") == "UP"
    extreme = F.when(up, F.array_min(F.transform(part, lambda x: x["low"]))).otherwise(F.array_max(F.transform(part, lambda x: x["high"])))
    total = lambda k: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x[k])
    g = g.withColumns({"retrace_extreme": extreme, "retrace_buy_vol": total("buy_volume"), "retrace_sell_vol": total("sell_volume"), "entry_bar": F.element_at("path", F.col("retrace_bars"))})
    gone = F.when(up, F.col("breakout_close") - F.col("retrace_extreme")).otherwise(F.col("retrace_extreme") - F.col("breakout_close"))
    whole = F.when(up, F.col("breakout_close") - F.col("consol_low")).otherwise(F.col("consol_high") - F.col("breakout_close"))
    g = g.withColumn("retrace_pct", F.when(whole > 0, gone / whole).otherwise(0.0)).where(F.col("retrace_pct") >= min_pct)
    first = g.groupBy("zone_id").agg(F.min_by(F.struct("retrace_bars", "retrace_extreme", "retrace_pct", "retrace_buy_vol", "retrace_sell_vol", F.col("entry_bar.bar_time").alias("last_time")), "retrace_bars").alias("x")).select("zone_id", "x.*")
    both = F.col("retrace_buy_vol") + F.col("retrace_sell_vol")
    return first.withColumn("retrace_imbalance", F.coalesce(F.try_divide((F.col("retrace_buy_vol") - F.col("retrace_sell_vol")).cast("double"), both.cast("double")), F.lit(0.0)))


def tick_numbers(ticks: DataFrame) -> DataFrame:
    """ticks with tick_no from 0, unless they have it."""
    return ticks if "tick_no" in ticks.columns else numbered(ticks, time_block("ts"), ["ts", "record_num"], "tick_no")


class Extremes:
    """Highs and lows of a row of days, and of every stretch of 1, 2, 4 ... of them, for the first day that reaches a level."""

    def __init__(self, day: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.day, self.high, self.low = day, [high], [low]
        step = 1
        while 2 * step <= len(day):
            h, lo = self.high[-1], self.low[-1]
            self.high.append(np.maximum(h[:-step], h[step:]))
            self.low.append(np.minimum(lo[:-step], lo[step:]))
            step *= 2

    def first(self, after: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The place of the first day after each given one whose high is at least `above` or low at most `below`; as many as there are days if none."""
        at, n = np.searchsorted(self.day, after, side="right"), len(self.day)
        for k in range(len(self.high) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) <= n)
            there = at[fits]
            calm = (self.high[k][there] < above[fits]) & (self.low[k][there] > below[fits])
            at[fits[calm]] += 1 << k
        return at


def first_touch(entries: DataFrame, numbered_ticks: DataFrame, width: str) -> DataFrame:
    """For (event_id, side, entry_no, entry_tick_ts, target, stop) the first later tick at the target or stop: (event_id, outcome, touch_no, touch_ts).

    Extremes lead to it.  Those of days, one row a day of the calendar and so a bounded table, are sent to the tasks, where each event finds
    the first later day that touches by halving; the bars of the entry's day and that one, an array a day, give the first bar; and only two bars' ticks are
    looked at.  Events without a touch aren't returned.
    """
    t = numbered_ticks.select(bar_time(width).alias("bt"), "ts", "tick_no", "price")
    bars = t.groupBy("bt").agg(F.max("price").alias("high"), F.min("price").alias("low"))
    number = F.datediff(F.to_date("bt"), F.lit("1970-01-01").cast("date")).alias("day")
    days = bars.groupBy(number).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("bt", "high", "low"))).alias("path"))
    days = written(days, "touch-days")
    calendar = days.select("day", "high", "low").orderBy("day").toPandas()
    up = F.col("side") == "UP"
    e = entries.withColumns({"e_day": F.datediff(F.to_date("entry_tick_ts"), F.lit("1970-01-01").cast("date")), "e_bt": F.window("entry_tick_ts", width)["start"], "above": F.when(up, F.col("target")).otherwise(F.col("stop")), "below": F.when(up, F.col("stop")).otherwise(F.col("target"))})
    held = entries.sparkSession.sparkContext.broadcast(Extremes(calendar["day"].to_numpy(), calendar["high"].to_numpy(), calendar["low"].to_numpy()))

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = held.value.first(pdf["e_day"].to_numpy(), pdf["above"].to_numpy(), pdf["below"].to_numpy())
            there = at < len(held.value.day)
            days_of = np.concatenate([pdf["e_day"].to_numpy(), held.value.day[at[there]]])
            yield pd.concat([pdf, pdf[there]]).assign(d=days_of)

    kinds = ", ".join(f"{c} {t}" for c, t in e.dtypes)
    two_days = e.mapInPandas(later, f"{kinds}, d int").join(days.select("day", "path"), F.col("d") == F.col("day"))
    touches = lambda b: (b["bt"] > F.col("e_bt")) & ((b["high"] >= F.col("above")) | (b["low"] <= F.col("below")))
    there = F.get(F.filter("path", touches), F.lit(0))["bt"]
    own = F.when(F.col("d") == F.col("e_day"), F.array("e_bt", there)).otherwise(F.array(there))
    two_bars = two_days.select(*e.columns, F.explode(F.array_compact(own)).alias("bt"))
    price = F.col("price")
    ticks_there = two_bars.join(t, "bt").where((F.col("tick_no") > F.col("entry_no")) & ((price >= F.col("above")) | (price <= F.col("below"))))
    won = F.when(F.col("side") == "UP", price >= F.col("target")).otherwise(price <= F.col("target"))
    return ticks_there.groupBy("event_id").agg(F.min_by(F.struct(F.when(won, "success").otherwise("fail").alias("outcome"), F.col("tick_no").alias("touch_no"), F.col("ts").alias("touch_ts")), "tick_no").alias("x")).select("event_id", "x.*")


def pattern_events(bars: DataFrame, ticks: DataFrame, width: str = "1 minute", min_bars: int = 5, max_bars: int = 10, min_volume: float = 2000, min_balance: float = 0.4, min_body: float = 4, max_retrace_bars: int = 5, min_retrace: float = 0.5, target_ticks: int = 50, stop_ticks: int = 20) -> DataFrame:
    """One row a pattern, with the 31 fields of an event.  bars and ticks are read several times: give frames that are in files."""
    numbers = tick_numbers(ticks).select("ts", "tick_no", "price")
    # Few zones break out: the rest need no profile.
    found = written(breakouts(consolidation_zones(bars, min_bars, max_bars, min_volume), bars, min_body), "pattern-breakouts")
    profile = written(volume_profile(found, bars, ticks, width), "pattern-profile")
    found = found.join(profile_metrics(profile, found).where(F.col("balance") >= min_balance), "zone_id")
    back = retracements(found, bars, max_retrace_bars, min_retrace)
    levels = level_class(profile, back.select("zone_id", F.col("retrace_extreme").alias("at")))
    step = F.expr(f"INTERVAL {seconds(width)} SECONDS")
    d = found.join(back, "zone_id").join(levels, "zone_id").withColumn("entry_time", F.col("last_time") + step)
    d = asof_join(d, numbers, "entry_time", "ts", "forward", "tick_no").where(F.col("match").isNotNull())
    sign = F.when(F.col("breakout_direction") == "UP", 1).otherwise(-1)
    d = d.withColumns({"entry_price": F.col("match.price"), "entry_no": F.col("match.tick_no"), "entry_tick_ts": F.col("match.ts")})
    d = d.withColumns({"target": F.col("entry_price") + sign * target_ticks * TICK_SIZE, "stop": F.col("entry_price") - sign * stop_ticks * TICK_SIZE})
    d = written(d, "pattern-entries")
    touched = first_touch(d.select(F.col("zone_id").alias("event_id"), F.col("breakout_direction").alias("side"), "entry_no", "entry_tick_ts", "target", "stop"), numbers, width)
    last = numbers.agg(F.max("tick_no").alias("last_no"), F.max_by("ts", "tick_no").alias("last_ts"))
    d = d.join(touched, F.col("zone_id") == F.col("event_id"), "left").join(F.broadcast(last))
    end = F.coalesce("touch_ts", "last_ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
    return d.select(
        "consol_start", (F.col("last_bar") + step).alias("consol_end"), "consol_bars", "consol_high", "consol_low", "consol_range_ticks", "consol_avg_vol", F.col("balance").alias("consol_balance_score"), F.col("poc_centrality").alias("consol_poc_centrality"),
        "max_single_buy_pre", "max_single_sell_pre", "dominant_side_pre", "dominant_strength_pre", "breakout_time", "breakout_direction", "breakout_close", "breakout_body_ticks", "breakout_volume", "breakout_imbalance", "breakout_vwap_position",
        "retrace_bars", "retrace_extreme", "retrace_pct", F.col("level_type").alias("retrace_level_type"), "retrace_buy_vol", "retrace_sell_vol", "retrace_imbalance", "entry_price",
        F.coalesce("outcome", F.lit("timeout")).alias("outcome"), (F.coalesce("touch_no", "last_no") - F.col("entry_no")).alias("ticks_to_resolve"), ((micros(end) - micros("entry_time")) / 1e6).alias("seconds_to_resolve"),
    )


#: The families of hit rates, and their half-open buckets in order.
IMBALANCE = (("strong_buy (>0.5)", 0.5, 1.01), ("moderate (0.2-0.5)", 0.2, 0.5), ("weak (<0.2)", -0.2, 0.2), ("moderate_sell (-0.5--0.2)", -0.5, -0.2), ("strong_sell (<-0.5)", -1.01, -0.5))
RETRACE = (("50%-60%", 0.5, 0.6), ("60%-70%", 0.6, 0.7), ("70%-80%", 0.7, 0.8), ("80%-90%", 0.8, 0.9), ("90%-101%", 0.9, 1.01))
VWAP = (("high_conviction (>0.7)", 0.7, 1.01), ("moderate (0.4-0.7)", 0.4, 0.7), ("low_conviction (<0.4)", 0.0, 0.4))
ABSORBED, WEAK = "retrace_absorbed (counter-dir dominant)", "retrace_weak (same-dir or neutral)"
STRONG_SIDE, WEAK_SIDE = "strong_dominant_>150", "weak_dominant_<=150"
ALWAYS = (("by_direction", "UP"), ("by_direction", "DOWN"), ("by_pre_strength", STRONG_SIDE), ("by_pre_strength", WEAK_SIDE), ("overall", "all"))


def pattern_totals(events: DataFrame) -> DataFrame:
    """One row: patterns, successes, fails, timeouts, and the hit rate of those resolved."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    resolved = count("success") + count("fail")
    return events.agg(F.count(F.lit(1)).alias("total_patterns"), count("success").alias("successes"), count("fail").alias("fails"), count("timeout").alias("timeouts"), F.coalesce(F.try_divide(count("success").cast("double"), resolved.cast("double")), F.lit(0.0)).alias("hit_rate"))


def pattern_stats(events: DataFrame) -> DataFrame:
    """(stratum, category, n, success, hit_rate) over resolved events; direction, strength and overall are there even if empty."""

    def bucket(x: str, edges) -> Column:
        return F.coalesce(*(F.when((F.col(x) >= lo) & (F.col(x) < hi), name) for name, lo, hi in edges))

    up = F.col("breakout_direction") == "UP"
    absorbed = (up & (F.col("retrace_imbalance") < -0.3)) | (~up & (F.col("retrace_imbalance") > 0.3))
    families = {
        "overall": F.lit("all"),
        "by_direction": F.col("breakout_direction"),
        "by_pre_strength": F.when(F.col("dominant_strength_pre") > 150, STRONG_SIDE).otherwise(WEAK_SIDE),
        "by_breakout_imbalance": bucket("breakout_imbalance", IMBALANCE),
        "by_retrace_pct": bucket("retrace_pct", RETRACE),
        "by_retrace_level": F.col("retrace_level_type"),
        "by_retrace_imbalance": F.when(absorbed, ABSORBED).otherwise(WEAK),
        "by_vwap_conviction": bucket("breakout_vwap_position", VWAP),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("stratum"), v.alias("category")) for k, v in families.items())))
    won = (F.col("outcome") == "success").cast("long")
    counted = events.where("outcome <> 'timeout'").select(won.alias("won"), rows.alias("x")).select("won", "x.*").where(F.col("category").isNotNull())
    spark = events.sparkSession
    zero = spark.createDataFrame([(*x, 0, 0) for x in ALWAYS], "stratum string, category string, n long, success long")
    both = counted.groupBy("stratum", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("success")).unionByName(zero)
    total = both.groupBy("stratum", "category").agg(F.sum("n").alias("n"), F.sum("success").alias("success"))
    return total.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("success").cast("double"), F.col("n").cast("double")), F.lit(0.0)))
