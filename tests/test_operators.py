"""Small inputs with results worked out by hand, and sequential models of the path-dependent operators."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickforge.functions import market
from tickforge.operators import asof, bars, chain, features, labels, models, ordering, patterns
from tickforge.sources import binary, events, tables
from tickforge.streaming import live

T0 = datetime(2024, 1, 2, 14, 0)


def ticks(spark, rows):
    """(seconds, price, low, high, count)"""
    d = [(i, T0 + timedelta(seconds=s), float(p), float(lo), float(hi), n, "f") for i, (s, p, lo, hi, n) in enumerate(rows)]
    return events.enrich(spark.createDataFrame(d, "record_num long, ts timestamp_ntz, price double, level_low double, level_high double, txn_count long, source_file string"))


def test_quote_rule_buy_wins_and_unknown_is_neutral(spark):
    got = [r["direction"] for r in ticks(spark, [(0, 10, 10, 10, 1), (1, 10, 9, 10, 1), (2, 10, 10, 11, 1), (3, 10, 9, 11, 1)]).orderBy("record_num").collect()]
    assert got == [1, 1, -1, 0]


def test_bar_of_ties_runs_and_zero_volume(spark):
    t = ticks(spark, [(0, 10, 9, 10, 2), (0, 11, 10, 11, 3), (1, 12, 12, 13, 0), (59, 13, 13, 15, 4), (61, 5, 4, 5, 0)])
    a, b = bars.time_bars(t, "1 minute").orderBy("bar_time").collect()
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["max_buy_run"], a["max_sell_run"]) == (10, 13, 10, 13, 9, 2, 2)
    assert b["flow_imbalance"] is None and b["vwap"] is None and b["max_sell_run"] == 0


def test_session_delta_restarts_at_six(spark):
    d = [(0, datetime(2024, 1, 2, 17, 59), 10.0, 9.0, 10.0, 5, "f"), (1, datetime(2024, 1, 2, 18, 0), 10.0, 9.0, 10.0, 7, "f")]
    t = events.enrich(spark.createDataFrame(d, "record_num long, ts timestamp_ntz, price double, level_low double, level_high double, txn_count long, source_file string"))
    assert [r[0] for r in bars.session_cvd(t).orderBy("record_num").select("cumulative_volume_delta").collect()] == [5, 7]


def test_rounding_clips_and_new_york_summer_time(spark):
    d = spark.createDataFrame([(0.625, datetime(2024, 7, 1, 13, 30)), (0.875, datetime(2024, 1, 2, 13, 30)), (None, None)], "x double, t timestamp_ntz")
    rows = d.select(market.round_to_tick(F.col("x")), market.at_least(F.col("x"), 0.7), market.is_rth(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.7, True), (1.0, 0.875, False), (None, None, None)]


def test_prefix_sums_and_margins_are_as_over_the_whole(spark):
    rnd = random.Random(1)
    d = spark.createDataFrame([(i, rnd.randint(-5, 5)) for i in range(500)], "seq long, v long")
    p = ordering.prefix_sums(d, F.floor(F.col("seq") / 37), ["seq"], {"s": F.col("v")}).toPandas().sort_values("seq")
    assert (p["s"].to_numpy() == p["v"].cumsum().to_numpy()).all()
    m = ordering.prefix_max(d, F.floor(F.col("seq") / 37), ["seq"], "m", F.col("v")).toPandas().sort_values("seq")
    assert (m["m"].to_numpy() == m["v"].cummax().to_numpy()).all()
    w = ordering.margin_window("seq").rowsBetween(-9, 3)
    g = ordering.own_rows(ordering.with_margin(d, "seq", 9, 3, block=20).withColumn("s", F.sum("v").over(w))).toPandas().sort_values("seq")
    v = g["v"].to_numpy()
    assert len(g) == 500 and [v[max(0, i - 9) : i + 4].sum() for i in range(500)] == g["s"].tolist()


def test_warm_up_is_null(spark):
    b = [(i, T0 + timedelta(minutes=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 10, 6, 4, 0.2, 0.1, 10.0, 3, 1) for i in range(25)]
    d = spark.createDataFrame(b, "bar_seq long, bar_time timestamp_ntz, open double, high double, low double, close double, volume long, buy_volume long, sell_volume long, flow_imbalance double, intensity double, vwap double, max_single_txn long, num_events long")
    f = features.second_generation(d).toPandas().sort_values("bar_seq")
    assert f["swing_high_dist"].isna().sum() == 19 and f["roll_3_volatility"].isna().sum() == 3 and f["atr_14"].notna().all() and f["cvd"].iloc[-1] == 50


def sequential_chain(c):
    out, free = [], None
    for s, f in sorted(c):
        if free is None or s >= free:
            out.append(s)
            if f is None:
                break
            free = f
    return out


def test_chain_over_blocks(spark):
    rnd = random.Random(3)
    for end in (False, True):
        seqs = sorted(rnd.sample(range(3000), 400))
        c = [(s, None if end and i == 300 else s + rnd.randint(1, 90)) for i, s in enumerate(seqs)]
        d = spark.createDataFrame(c, "seq long, free long")
        assert sorted(r[0] for r in chain.greedy_chain(d, "seq", "free", block=100).select("seq").collect()) == sequential_chain(c)
    assert chain.greedy_chain(spark.createDataFrame([], "seq long, free long"), "seq", "free").count() == 0
    # Far jumps over empty blocks, long chains of small blocks, negative places.
    for low, high, reach, block in ((-500, 500, 5, 3), (0, 100_000, 30_000, 50), (-10_000, 10_000, 400, 64)):
        seqs = sorted(rnd.sample(range(low, high), 700))
        c = [(s, s + rnd.randint(1, reach)) for s in seqs]
        d = spark.createDataFrame(c, "seq long, free long")
        assert sorted(r[0] for r in chain.greedy_chain(d, "seq", "free", block=block).select("seq").collect()) == sequential_chain(c)


def test_pointers_are_doubled(spark):
    """A chain of 1,000 runs is walked in ten rounds or so; runs beside it aren't seen."""
    p = spark.createDataFrame([(i, i + 1) for i in range(999)] + [(5000 + i, i) for i in range(50)], "hi long, next long")
    assert sorted(r[0] for r in chain.visited(p, 0).collect()) == list(range(1000))
    assert sorted(r[0] for r in chain.visited(p, 995).collect()) == [995, 996, 997, 998, 999]
    assert [r[0] for r in chain.visited(p, 999).collect()] == [999]



def test_barriers_against_a_loop(spark):
    rnd = random.Random(5)
    b, p = [], 100.0
    for i in range(150):
        p += rnd.choice((-1.5, -0.5, 0.5, 1.5))
        b.append((i, T0 + timedelta(minutes=i), p + 1, p - 1, p))
    d = spark.createDataFrame(b, "bar_seq long, bar_time timestamp_ntz, high double, low double, close double")
    got = labels.triple_barrier(d, max_hold=20).orderBy("bar_seq").collect()
    for i, r in enumerate(got):
        stop, want = r["sl_points"], (0, 20, 0.0, 0.0)
        mae = mfe = 0.0
        for j in range(i + 1, min(i + 21, 150)):
            mfe, mae = max(mfe, b[j][2] - b[i][4]), max(mae, b[i][4] - b[j][3])
            if b[j][3] <= b[i][4] - stop:
                want = (-1, j - i)
                break
            if b[j][2] >= b[i][4] + 1.5 * stop:
                want = (1, j - i)
                break
        assert (r["long_result"], r["long_bars_held"]) == want[:2] and abs(r["long_mae"] - mae) < 1e-5 and abs(r["long_mfe"] - mfe) < 1e-5


def test_zones_are_greedy(spark):
    v = [10] * 12 + [0] * 5 + [10] * 6
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "bar_seq long, volume long")
    z = sorted((r["start_seq"], r["end_seq"]) for r in patterns.consolidation_zones(d, min_volume=10).collect())
    assert z == [(0, 9), (17, 21)] or z == [(0, 9), (17, 22)]


def test_asof_ties_and_ends(spark):
    right = spark.createDataFrame([(datetime(2024, 1, 1, 10), 1), (datetime(2024, 1, 3, 10), 2)], "rt timestamp_ntz, v int")
    left = spark.createDataFrame([(datetime(2024, 1, 2, 10),), (datetime(2023, 12, 31),), (datetime(2024, 1, 9),), (datetime(2024, 1, 1, 11),)], "lt timestamp_ntz")
    of = lambda how: {str(r["lt"]): r["match"] and r["match"]["v"] for r in asof.asof_join(left, right, "lt", "rt", how).collect()}
    assert list(map(of("nearest").get, ("2024-01-02 10:00:00", "2023-12-31 00:00:00", "2024-01-09 00:00:00", "2024-01-01 11:00:00"))) == [2, 1, 2, 1]
    assert of("backward")["2023-12-31 00:00:00"] is None and of("forward")["2024-01-09 00:00:00"] is None


def test_binary_round_trip(spark, tmp_path):
    n = 20
    rows = pd.DataFrame({"ticks": 638_397_504_000_000_000 + np.arange(n) * 10_000_000, "price": 100 + np.arange(n) * 0.25, "level_low": 99 + np.arange(n) * 0.25, "level_high": 100 + np.arange(n) * 0.25, "txn_count": np.arange(n) + 1, "flag": 1})
    (tmp_path / "a.data").write_bytes(binary.encode(binary.TICK, rows) + b"xyz")
    (tmp_path / "b.data").write_bytes(b"")
    t = binary.read_ticks(spark, str(tmp_path), glob="*.data").orderBy("record_num").collect()
    assert len(t) == n and t[3]["price"] == 100.75 and t[0]["direction"] == 1 and str(t[1]["ts"]) == "2024-01-02 00:00:01" and t[0]["source_file"] == "a.data"
    assert binary.read_ticks(spark, str(tmp_path), strict=True, glob="*.data").count() == 0


def test_bar_files_have_sixty_byte_records(spark, tmp_path):
    b = spark.createDataFrame([(T0, 1.0, 2.0, 0.5, 1.5, 3, 4, 7)], "bar_time timestamp_ntz, open double, high double, low double, close double, buy_volume long, sell_volume long, volume long")
    assert tables.write_bar_files(b, str(tmp_path)) == 1
    r = binary.read_minute_bars(spark, str(tmp_path), glob="*.data").first()
    assert (r["ts"], r["open"], r["close"], r["buy_count"], r["volume_delta"], r["cumulative_volume"]) == (T0, 1.0, 1.5, 3, -1, 7)


def test_walk_forward_and_metrics(spark):
    assert models.walk_forward(100, 5, 0.5) == [(i, 50 + 10 * i, 60 + 10 * i) for i in range(5)]
    assert models.walk_forward(100, 5, 0.5, 60) == [(i, 50 + 10 * i, 60 + 10 * i) for i in range(2, 5)]
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    m = models.classification_metrics(d).first()
    assert m["accuracy"] == 0.75 and abs(m["precision"] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-9


def test_streamed_bars_equal_batch_on_closed_bars(spark, tmp_path):
    t = ticks(spark, [(i * 7, 100 + (i * i) % 5, 99, 100 + (i * i) % 5, i % 4 + 1) for i in range(100)])
    t = t.select("record_num", "ts", "price", "level_low", "level_high", "txn_count", "direction", "volume_delta")
    for k in range(4):
        t.where(f"record_num DIV 25 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.stream_bars(live.stream_ticks(spark, str(tmp_path / "in"), files_per_trigger=1))
    q = live.watch(s, str(tmp_path / "h"), lambda b: b.limit(1), str(tmp_path / "c"), once=True)
    q.awaitTermination(90)
    key = lambda df: sorted(tuple(r) for r in df.select("bar_time", "open", "high", "low", "close", "volume").collect())
    got, want = key(spark.read.parquet(str(tmp_path / "h"))), key(bars.time_bars(t, "1 minute", runs=False))
    assert len(got) >= len(want) - 3 and got == want[: len(got)]
