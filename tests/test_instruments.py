"""Several instruments in one table: two that are interleaved give what two runs of one give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickforge.operators import asof, backtest, bars, chain, features, labels, ordering
from tickforge.sources import events

BY = ["instrument"]
T0 = datetime(2024, 1, 2, 14, 0)
#: An unnamed instrument is one too.
NAMES = ("b", "a", None)


def one(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


def alone(df, name):
    return df.where(F.col("instrument").eqNullSafe(F.lit(name))).drop("instrument")


def same(whole, single, drop=("bar_seq",)):
    """whole has for each instrument what single gives of it alone, but for the numbers of lanes."""
    for name in NAMES:
        want = single(name)
        names = sorted(set(want.columns) - set(drop))
        assert names == sorted(set(whole.columns) - {"instrument", *drop})
        got = one(alone(whole, name).select(names).collect())
        assert got == one(want.select(names).collect()) and got, name


@pytest.fixture(scope="module")
def ticks(spark):
    rnd, rows = random.Random(5), []
    for k, name in enumerate(NAMES):
        price = 100.0 * (k + 1)
        # Some days apart in places, the same seconds in others.
        for i in range(1500):
            price += rnd.choice((-0.5, -0.25, 0.0, 0.25, 0.5))
            at = T0 + timedelta(seconds=7 * i + rnd.randint(0, 3) + (86400 * 3 if i > 900 + 100 * k else 0))
            rows.append((name, i, at, price, price - rnd.choice((0.0, 0.25)), price + rnd.choice((0.0, 0.25, 2.0)), rnd.randint(0, 9), "f"))
    rnd.shuffle(rows)
    raw = spark.createDataFrame(rows, "instrument string, record_num long, ts timestamp_ntz, price double, level_low double, level_high double, txn_count long, source_file string")
    return events.enrich(raw).cache()


@pytest.fixture(scope="module")
def minute(ticks):
    return bars.sequence(bars.time_bars(ticks, "1 minute", by=BY), BY).cache()


def single_bars(ticks, name):
    return bars.sequence(bars.time_bars(alone(ticks, name), "1 minute"))


def test_bars_and_deltas(ticks):
    same(bars.time_bars(ticks, "1 minute", by=BY), lambda n: bars.time_bars(alone(ticks, n), "1 minute"))
    same(bars.time_bars(ticks, "5 minutes", runs=False, by=BY), lambda n: bars.time_bars(alone(ticks, n), "5 minutes", runs=False))
    same(bars.cvd_bars(ticks, "1 hour", by=BY), lambda n: bars.cvd_bars(alone(ticks, n), "1 hour"))
    levels = bars.footprint(ticks, "5 minutes", by=BY)
    same(bars.diagonal_imbalance(levels, by=BY), lambda n: bars.diagonal_imbalance(bars.footprint(alone(ticks, n), "5 minutes")))


def test_numbers_have_lanes(minute):
    lanes = {r["instrument"]: (r["low"], r["high"], r["n"]) for r in minute.groupBy("instrument").agg(F.min("bar_seq").alias("low"), F.max("bar_seq").alias("high"), F.count("*").alias("n")).collect()}
    # Lanes go by name, none first, and are numbered without gaps.
    for k, name in enumerate((None, "a", "b")):
        low, high, n = lanes[name]
        assert (low, high) == (k * ordering.LANE, k * ordering.LANE + n - 1)


def test_features_and_labels(ticks, minute):
    same(features.second_generation(minute, BY), lambda n: features.second_generation(single_bars(ticks, n)))
    same(labels.trade_labels(labels.triple_barrier(minute)), lambda n: labels.trade_labels(labels.triple_barrier(single_bars(ticks, n))))
    same(labels.forward_labels(minute, 3), lambda n: labels.forward_labels(single_bars(ticks, n), 3))


def test_margins_end_with_the_instrument(minute, ticks):
    """Blocks of a few bars: no window reaches into another lane."""
    w = ordering.margin_window().rowsBetween(-9, 3)
    total = lambda d: ordering.own_rows(ordering.with_margin(d, "bar_seq", 9, 3, block=16).withColumn("s", F.sum("volume").over(w))).select(*(c for c in BY if c in d.columns), "bar_time", "s")
    same(total(minute), lambda n: total(single_bars(ticks, n)))


def scored(b):
    p = F.pmod(F.unix_seconds(F.col("bar_time").cast("timestamp")) / 60 * 37 + F.col("close") * 8, F.lit(100)) / 100
    return b.withColumns({"prob_long": p, "prob_short": 1 - p, "quality": F.lit(None).cast("double"), "atr": F.lit(2.0)})


def test_trades_and_figures(ticks, minute):
    rules = {"threshold": 0.55, "max_hold": 5}
    every = backtest.trades(scored(minute), BY, **rules)
    of = {n: backtest.trades(scored(single_bars(ticks, n)), **rules) for n in NAMES}
    same(every, of.get, drop=("bar_seq", "exit_seq", "next_free"))
    same(backtest.equity_curve(minute, every, BY), lambda n: backtest.equity_curve(single_bars(ticks, n), of[n]))
    same(backtest.drawdown(every, BY), lambda n: backtest.drawdown(of[n]), drop=("bar_seq", "exit_seq", "next_free"))
    same(backtest.metrics(every, BY), lambda n: backtest.metrics(of[n]))


def test_chains_of_lanes(spark):
    rnd = random.Random(8)
    lane, rows, want = 1000, [], []
    # A lane without candidates, one whose chain ends early, one that would run over its end, negative places.
    for k in (-2, 0, 1, 3, 4):
        free, ended = None, False
        for s in sorted(rnd.sample(range(700), 60)):
            end = k == 1 and s > 400
            nxt = None if end else s + rnd.randint(1, 900 if k == 3 else 40)
            rows.append((k * lane + s, None if nxt is None else k * lane + nxt))
            if not ended and (free is None or s >= free):
                want.append(k * lane + s)
                free, ended = nxt, end
    d = spark.createDataFrame(rows, "seq long, free long")
    for block in (30, 1000, 50_000):
        assert sorted(r[0] for r in chain.greedy_chain(d, "seq", "free", block=block, lane=lane).collect()) == want


@pytest.mark.parametrize("how", ["backward", "forward", "nearest"])
def test_asof_by_instrument(ticks, minute, how):
    left = ticks.where("record_num % 50 = 7").select("instrument", "record_num", "ts")
    right = minute.where("bar_seq % 3 = 0").select("instrument", F.col("bar_time").alias("at"), "close")
    # One instrument has nothing to match.
    right = right.where("NOT coalesce(instrument = 'a', false)")
    got = asof.asof_join(left, right, "ts", "at", how, by=BY).withColumn("match", F.when(F.col("match").isNotNull(), F.struct("match.at", "match.close")))
    for name in ("b", None):
        want = asof.asof_join(alone(left, name), alone(right, name), "ts", "at", how)
        assert one(alone(got, name).select("record_num", "match").collect()) == one(want.select("record_num", "match").collect())
    assert [r[0] for r in alone(got, "a").select("match.at").distinct().collect()] == [None]
