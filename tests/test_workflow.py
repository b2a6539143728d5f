"""Features, training, backtest, explanation, viewer and live signals end to end over a small folder of binary ticks."""

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge import __main__ as cli
from tickforge.operators import models, shapley
from tickforge.plans import learning, workflow
from tickforge.sources import binary, tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two trading days of ticks every 20 seconds."""
    out, r = tmp_path_factory.mktemp("ticks"), random.Random(3)
    price = 4000.0
    for day in range(2):
        rows = []
        for k in range(3 * 60 * 9):  # 13:30 to 22:30, UTC
            side = r.choice((1, -1))
            price += side * r.choice((0.0, 0.25, 0.5)) + (0.25 if k % 240 < 120 else -0.25) * r.choice((0, 1))
            rows.append((638_397_504_000_000_000 + (day * 86_400 + 13 * 3600 + 1800 + 20 * k) * 10_000_000, price, price - (1 if side > 0 else 0), price + (0 if side > 0 else 1), r.randint(1, 60)))
        d = pd.DataFrame(rows, columns=["ticks", "price", "level_low", "level_high", "txn_count"])
        (out / f"day{day}.data").write_bytes(binary.encode(binary.TICK, d))
    return str(out)


def test_durations():
    assert [workflow.duration(x) for x in ("1min", "5 minutes", "2h", "30s", "1 day")] == [60, 300, 7200, 30, 86400]
    with pytest.raises(ValueError):
        workflow.duration("soon")


def test_trading_chain(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.main(["run-trading", folder, "1min", "1.5", "30", "1", "--trees", "2", "--output", out])
    kept, meta = learning.load(spark, f"{out}/models")
    assert set(kept) == set(meta["models"]) and {"signal", "volatility"} <= set(kept) and set(meta["averages"]) == set(learning.SECOND)
    assert len(meta["features"]) > 60 and not set(meta["features"]) & learning.EXCLUDED
    trades = tables.read_trades(spark, f"{out}/backtest/trades.csv")
    assert json.loads(spark.read.text(f"{out}/backtest/metrics").first()[0])["n_trades"] == trades.count()
    assert "n_trades" in tables.read_text(spark, f"{out}/backtest/report.txt") and "Trade factors" in tables.read_text(spark, f"{out}/explanation/report.txt")
    factors = spark.read.json(f"{out}/explanation/global_factors")
    assert factors.count() > 5 and {"rank", "feature", "importance"} <= set(factors.columns)
    assert sum(binary.BAR.itemsize for f in os.listdir(f"{out}/viewer/bars") if f.endswith(".data")) == 120
    bars = binary.read_minute_bars(spark, f"{out}/viewer/bars", glob="*.data")
    assert bars.count() == spark.read.parquet(f"{out}/features.parquet").count()
    doc = json.loads("".join(r[0] for r in spark.read.text(f"{out}/viewer/trades").collect()))
    assert len(doc["trades"]) == trades.count()
    # backtest, explain and live again as commands of their own
    cli.main(["backtest", f"{out}/models", "--features", f"{out}/features.parquet", "--max-hold", "30", "--output", f"{out}/again"])
    assert sorted(map(str, tables.read_trades(spark, f"{out}/again/trades.csv").collect())) == sorted(map(str, trades.collect()))
    cli.main(["live", f"{out}/models", "--file", f"{folder}/day1.data", "--tail", "5"])
    assert "NO_TRADE" in capsys.readouterr().out
    cli.main(["live", f"{out}/models", "--watch", folder, "--work", f"{out}/work", "--once"])
    said = spark.read.parquet(f"{out}/work/signals").collect()
    assert len(said) == 1 and str(said[0]["bar_time"]) == "2024-01-03 22:29:00" and said[0]["signal"] in ("LONG", "SHORT", "NO_TRADE") and said[0]["prob_long"] is not None
    # Shapley values sum to the margin, and permutation importance
    d = spark.read.parquet(f"{out}/features.parquet").dropna(subset=meta["features"]).orderBy("bar_seq").limit(3)
    names = meta["features"]
    got = {(r["bar_seq"], r["feature"]): r["contribution"] for r in learning.contributions(kept["signal"], d, names).collect()}
    margin = {r["bar_seq"]: r["rawPrediction_2"][1] for r in kept["signal"].transform(d).collect()}
    base = shapley.expectations(spark, kept["signal"])[2]
    assert len(got) == 3 * len(names) and all(abs(sum(got[k, f] for f in names) + base - m) < 1e-9 for k, m in margin.items())
    said = learning.transformed(kept["signal"], d).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["probability"][int(r["prediction"])] == max(r["probability"]) for r in said)
    folds = meta["folds"]["signal"]
    assert all(len(f["rounds"]) == 3 and 1 <= min(f["rounds"]) <= max(f["rounds"]) <= 2 and {"accuracy_trades", "precision_trades", "n_trades_test"} <= set(f) for f in folds)
    top = learning.top_factors(learning.contributions(kept["signal"], d, names)).collect()
    assert len(top) == 15 and all(abs(got[r["bar_seq"], r["feature"]]) >= 0 for r in top)
    t = learning.labelled(spark.read.parquet(f"{out}/features.parquet").dropna(subset=names), "signal")
    loss = dict(learning.permutation_importance(kept["signal"], t, names, names[:3]))
    assert set(loss) == set(names[:3]) and learning.importance(kept["signal"], names, 5)[0][1] > 0


def test_first_generation_chain(spark, folder, tmp_path):
    out = str(tmp_path / "first")
    cli.main(["run-all", folder, "1min", "5min", "--trees", "2", "--output", out])
    p = spark.read.csv(f"{out}/predictions.csv", header=True, inferSchema=True)
    assert p.count() > 900 and {r[0] for r in p.select("signal").distinct().collect()} <= {"UP", "DOWN", "HOLD"}
    cli.main(["predict", folder, "--models-dir", f"{out}/models", "--output", f"{out}/p.csv", "--tail", "3"])
    assert spark.read.csv(f"{out}/p.csv", header=True).count() == p.count()


def test_charts_patterns_and_ingest(spark, folder, tmp_path):
    out = str(tmp_path / "c")
    cli.main(["charts", f"{folder}/day0.data", "--interval", "5min", "-o", out])
    assert spark.read.parquet(f"{out}/bars.parquet").count() == 108 and spark.read.parquet(f"{out}/footprint.parquet").count() > 100
    cli.main(["patterns", folder, "--window", "5min", "--min-vol", "100", "--min-balance", "0", "--min-body", "1", "--cache-dir", f"{out}/cache", "-o", f"{out}/events.csv"])
    first = binary.ingest(spark, folder, f"{out}/cache").count()
    assert first == 2 * 1620 == binary.ingest(spark, folder, f"{out}/cache").count()
    # Bars of seven minutes start at midnight, not at a multiple of seven since 1970.
    cli.main(["charts", f"{folder}/day1.data", "--interval", "7min", "-o", f"{out}/seven"])
    first = {n: str(spark.read.parquet(f"{out}/seven/{n}.parquet").agg(F.min("bar_time")).first()[0]) for n in ("bars", "cvd", "footprint")}
    assert set(first.values()) == {"2024-01-03 13:25:00"}
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        binary.required(spark, str(tmp_path / "empty"))
    v = binary.viewer_ticks(binary.read_ticks(spark, folder, glob="*.data")).agg(F.max(F.date_format("ts", "SSSSSS"))).first()[0]
    assert v == "000000"


def test_samples_and_distribution(spark):
    d = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    a, b = models.random_sample(d, 10, key="k"), models.random_sample(d, 10, key="k")
    assert a.count() == 10 and sorted(a.collect()) == sorted(b.collect())
    assert np.isclose(sum(r["pct"] for r in models.distribution(d, "c").collect()), 100)


def test_figures_of_trades_alone(spark):
    rows = [(1.0, 1.0)] * 9 + [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (2.0, 2.0)]
    d = spark.createDataFrame(rows, "label double, prediction double")
    m = models.trade_metrics(d).first()
    # Said: 0 once and rightly, 2 twice and once rightly; three rows are 0 and one is 2.
    assert (m["accuracy_trades"], m["precision_trades"], m["n_trades_test"]) == (0.5, (3 * 1 + 1 * 0.5) / 4, 4)
    assert tuple(models.trade_metrics(d.where("label = 1")).first()) == (0.0, 0.0, 0)


def test_boosting_stops_by_held_rows_and_small_tables_are_left_out(spark):
    r = random.Random(5)
    rows = [(i, r.random(), r.random(), float(r.randint(0, 2))) for i in range(900)]
    d = spark.createDataFrame(rows, "bar_seq long, x double, y double, label double").withColumns({"trade_label": F.col("label") - 1, "is_rth": F.lit(True), "has_trade_outcome": F.lit(1), "quality_label": (F.col("x") > 0.5).cast("int")})
    # Labels of chance: a round that doesn't help on held rows ends it.
    model, report = learning.train(d.drop("label"), "signal", ["x", "y"], folds=1, trees=30, depth=2)
    assert all(n < 30 for n in report[0]["rounds"]) and len(learning.rounds(model)) == 3
    assert learning.train(d.drop("label").limit(200), "quality", ["x", "y"], folds=1)[0] is None
    assert learning.train(d.drop("label"), "quality", ["x", "y"], folds=1, trees=3)[1][0]["accuracy"] > 0.9


def test_bar_files_appear_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 10:{i % 60:02d}:00", 1.0 + i, 2.0 + i, 0.5, 1.5, i, 2 * i, 3 * i) for i in range(180)]
    d = spark.createDataFrame(rows, "t string, open double, high double, low double, close double, buy_volume long, sell_volume long, volume long").withColumn("bar_time", F.to_timestamp_ntz("t"))
    out = tmp_path / "bars"
    assert tables.write_bar_files(d, str(out)) == 180 and sorted(os.listdir(out)) == [f"2024-01-0{k}.data" for k in (1, 2, 3)]
    got = binary.read_minute_bars(spark, str(out), glob="*.data")
    assert got.count() == 180 and got.agg(F.sum("volume")).first()[0] == 3 * sum(range(180))
    last = got.groupBy("source_file").agg(F.max_by("cumulative_volume", "record_num").alias("c"), F.sum("volume").alias("v")).collect()
    assert all(r["c"] == r["v"] for r in last)
    # A task that fails: what was there stays as it was, and nothing is left beside it.
    before = {f: (out / f).read_bytes() for f in os.listdir(out)}
    broken = d.withColumn("high", F.when(F.col("t") == "2024-01-03 10:02:00", F.raise_error(F.lit("broken"))).otherwise(F.col("high") + 1))
    with pytest.raises(Exception, match="broken"):
        tables.write_bar_files(broken, str(out))
    assert {f: (out / f).read_bytes() for f in os.listdir(out)} == before
    assert tables.write_bar_files(d.where("t < '2024-01-02'"), f"file://{out}") == 60 and len(os.listdir(out)) == 3


def test_chains_have_defaults():
    a = cli.arguments().parse_args(["run-trading"])
    assert (a.data, a.window, a.rr, a.max_hold, a.folds, a.output) == ("data", "1min", "1.5", "60", "5", None)
    a = cli.arguments().parse_args(["run-all", "/x", "5min"])
    assert (a.data, a.window, a.horizon) == ("/x", "5min", "5min")
