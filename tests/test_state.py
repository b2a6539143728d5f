"""Live bars with keyed state against a batch over all ticks, trigger by trigger."""

import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickforge.operators import bars, features
from tickforge.streaming import live, state

START = pd.Timestamp("2024-01-02 14:00:00")
SCHEMA = live.TICK_SCHEMA + ", instrument string"


def ticks_of(n, seed, instrument="A", step=7, first=0, price=4000.0):
    r = random.Random(seed)
    rows, at = [], first
    for i in range(n):
        at += r.randint(0, step) + (200 if r.random() < 0.01 else 0)
        side = r.choice((1, -1, 1, -1, 0))
        price += 0.25 * r.randint(-2, 2)
        spread = r.choice((1.0, 2.0))
        rows.append((i, (START + pd.Timedelta(seconds=at)).to_pydatetime(), price, price - (spread if side == 1 else 0 if side == -1 else 0.5), price + (0 if side == 1 else spread if side == -1 else 0.5), r.randint(1, 60), side))
    return [(n, t, p, lo, hi, c, d, d * c, instrument) for n, t, p, lo, hi, c, d in rows]


def batch_bars(spark, rows):
    return bars.sequence(bars.time_bars(spark.createDataFrame(rows, SCHEMA), "1 minute"))


def close_to(a, b):
    return (a is None and b is None) or (isinstance(a, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a))) or a == b


def test_bars_of_ticks_are_those_of_the_batch(spark):
    rows = ticks_of(900, 1)
    want = batch_bars(spark, rows).orderBy("bar_time").collect()
    d = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).sample(frac=1, random_state=2)
    got = state.bars_of(d.assign(us=(d["ts"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)), 60_000_000)
    assert len(got) == len(want) > 50
    for g, w in zip(got.to_dict("records"), want, strict=True):
        assert all(close_to(w[k], v) for k, v in g.items() if k != "start"), (g, w)


def run(spark, folder, tmp_path, **more):
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    state.watch(live.stream_ticks(spark, folder, SCHEMA), features.second_generation, checkpoint, out, once=True, instrument="instrument", **more).awaitTermination(120)
    return spark.read.parquet(out) if os.path.isdir(out) else None


def test_triggers_add_up_to_the_batch(spark, tmp_path, late=60):
    """Two instruments in one stream; each trigger's fresh bars equal a batch over all ticks so far, closed and open ones."""
    a, b = ticks_of(700, 3), ticks_of(300, 4, "B", 15)
    end = max(a[-1][1], b[-1][1])
    cuts, sent, folder = [START + (end - START) * x for x in (0, 0.3, 0.34, 0.7, 1.01)], {"A": [], "B": []}, f"{tmp_path}/in"
    last = -1
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = {x: [r for r in rows if lo <= r[1] < hi] for x, rows in (("A", a), ("B", b))}
        spark.createDataFrame(part["A"] + part["B"], SCHEMA).write.mode("append").parquet(folder)
        for x, rows in part.items():
            sent[x] += rows
        said = run(spark, folder, tmp_path, late=late).where(F.col("batch") > last)
        got = said.collect()
        last = max(r["batch"] for r in got)
        for x in "AB":
            want = {r["bar_seq"]: r for r in features.second_generation(batch_bars(spark, sent[x])).collect()}
            own = {r["bar_seq"]: r for r in sorted((r for r in got if r["instrument"] == x), key=lambda r: (r["batch"], r["closed"]))}
            names = set(want[0].asDict())
            assert bool(own) == bool(part[x]) and (not own or max(own) == max(want)), (k, x)
            for seq, r in own.items():
                assert all(close_to(r[c], want[seq][c]) for c in names), (k, x, seq, [(c, r[c], want[seq][c]) for c in names if not close_to(r[c], want[seq][c])])
    # Every bar is told as closed once, but for those that are open at the end.
    closed = spark.read.parquet(f"{tmp_path}/out").where("closed AND instrument = 'A'").groupBy("bar_seq").count().collect()
    n = batch_bars(spark, a).count()
    assert {r["bar_seq"] for r in closed} >= set(range(n - 3)) and all(r["count"] == 1 for r in closed)


def test_state_and_scratch_stay_small(spark, tmp_path):
    """Many triggers: kept bars are bounded, nothing is left in the shared folder, late ticks are left out, the newest bar alone is told."""
    rows = ticks_of(1500, 5, step=9)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    folder = f"{tmp_path}/in"
    for k in range(6):
        spark.createDataFrame(rows[250 * k : 250 * k + 250], SCHEMA).write.mode("append").parquet(folder)
        said = run(spark, folder, tmp_path, keep=64, newest=True)
    assert said.groupBy("batch").count().where("count > 1").isEmpty() and said.count() >= 6
    spark.createDataFrame([(*rows[0][:2], 9999.0, *rows[0][3:])], SCHEMA).write.mode("append").parquet(folder)
    assert run(spark, folder, tmp_path, keep=64, newest=True).where("high > 9000").isEmpty()
    assert set(os.listdir(shared)) <= before | {"cache"}
    store = spark.read.format("statestore").option("stateVarName", "closed").option("path", f"{tmp_path}/checkpoint").load()
    assert store.count() == 64
    kept = spark.read.format("statestore").option("stateVarName", "ticks").option("path", f"{tmp_path}/checkpoint").load()
    assert kept.count() < 40


def test_sessions_of_instruments_do_not_mix(spark):
    b = spark.createDataFrame([(x, s, 0 if x == "A" else s, 60_000_000 * s, True, s > 2, 1.0) for x in "AB" for s in range(5)], "instrument string, bar_seq long, cvd long, start long, closed boolean, fresh boolean, price_volume double")
    b = b.withColumns({c: F.lit(1).cast("long") for c in ("volume", "num_events", "buy_volume", "sell_volume")})
    got = state.as_bars(b, "1 minute").orderBy("bar_seq").collect()
    gaps = np.diff([r["bar_seq"] for r in got])
    assert [r["true_seq"] for r in got] == [*range(5)] * 2 and sorted(gaps)[-1] > 20_000 and sorted(gaps)[:-1] == [1] * 8
