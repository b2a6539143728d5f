"""The chain from ticks to features, models, trades, explanations and live signals, as functions that the commands call."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import market
from tickforge.operators import asof, backtest, bars, features, labels, models, shapley
from tickforge.sources import tables
from tickforge.sources.scratch import written

from . import learning

UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "m": 60, "t": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}
#: Rows that explanations look at: trades with factors of their own, trades of a side, and rows of the global table.
PER_TRADE, PER_SIDE, SAMPLE = 50, 500, 2000


def duration(text: str) -> int:
    """Seconds of `1min`, `5 minutes`, `2h` and the like."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+?)s?\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * UNITS[m[2].lower()]


def width_of(text: str) -> str:
    return f"{duration(text)} seconds"


def feature_matrix(ticks: DataFrame, window: str = "1min", horizon: str = "5min", rr: float = 1.5, max_hold: int = labels.MAX_HOLD) -> DataFrame:
    """All features and labels; the newest bars stay, with NULL labels.  The horizon is counted in bars of the median gap.

    The matrix is written: filters on a hundred columns over the windows that make them would have the optimizer derive conditions without end.
    """
    width = width_of(window)
    b = written(bars.sequence(bars.time_bars(ticks, width, start=bars.anchor(ticks, width))), "bars")
    f = features.second_generation(b)
    for other in (labels.trade_labels(labels.triple_barrier(b, rr, max_hold)), labels.atr_target(b), labels.forward_labels(b, labels.bars_ahead(b, duration(horizon)))):
        f = f.join(other.select("bar_seq", *(c for c in other.columns if c not in f.columns)), "bar_seq")
    return written(f, "matrix")


def train_all(d: DataFrame, kinds: tuple[str, ...], path: str, folds: int = 5, trees: int = 20, **more) -> dict[str, list[dict]]:
    """Train the models of a generation and save them with their metadata; the reports of their folds."""
    names = learning.feature_columns(d)
    d = written(d, "training")
    kept, reports = {}, {}
    for kind in kinds:
        model, reports[kind] = learning.train(d, kind, names, folds, trees=trees)
        if model:
            kept[kind] = model
    learning.save(kept, path, names, reports, **more)
    return reports


def predictions(kept: dict[str, PipelineModel], names: list[str], d: DataFrame) -> DataFrame:
    """The first generation's predictions of every bar that has features, also the newest; what the models say is written, as in feature_matrix."""
    d = written(d.dropna(subset=names).select("bar_time", "close", *(n for n in names if n not in ("bar_time", "close"))), "to-predict")
    p = learning.probabilities(kept["direction"], d, ["_down", "prob_up"]).drop("_down")
    p = written(learning.predicted(kept["magnitude"], p, "magnitude_pred").select("bar_time", "close", "prob_up", "magnitude_pred"), "predicted")
    return p.select("bar_time", "close", "prob_up", "magnitude_pred").withColumns(market.prediction(F.col("prob_up"), F.col("magnitude_pred")))


def run_backtest(kept: dict[str, PipelineModel], names: list[str], d: DataFrame, out: str, rr: float = 1.5, signal_threshold: float = 0.55, quality_threshold: float = 0.5, max_hold: int = 60) -> DataFrame:
    """Trades, equity and metrics of the models' scores, written under out; the trades."""
    s = written(learning.scored(kept, names, d), "scored")
    taken = backtest.trades(s, rr=rr, threshold=signal_threshold, quality_threshold=quality_threshold, max_hold=max_hold)
    tables.write_table(taken.drop("bar_seq", "exit_seq", "next_free"), f"{out}/trades.csv")
    tables.write_table(backtest.equity_curve(s, taken), f"{out}/equity.csv")
    tables.write_metrics_json(backtest.metrics(taken), f"{out}/metrics")
    reasons = {r["exit_reason"]: r["n"] for r in backtest.exit_reasons(taken).collect()}
    tables.write_text(d.sparkSession, report("Backtest", [backtest.metrics(taken).first().asDict() | reasons]), f"{out}/report.txt")
    return taken


def explain(kept: dict[str, PipelineModel], names: list[str], d: DataFrame, trades: DataFrame, out: str) -> dict[str, DataFrame]:
    """Factors of each trade, of winners against losers and of all rows, by the signal model, written under out."""
    spark, model = d.sparkSession, kept["signal"]
    d = written(d.dropna(subset=names), "explained")
    at = asof.asof_join(trades.where("entry_time IS NOT NULL"), d.select("bar_time", "bar_seq"), "entry_time", "bar_time", "nearest")
    at = written(at.where(F.col("match").isNotNull()).withColumn("bar_seq", F.col("match.bar_seq")).drop("match"), "explained-trades")
    won = at.groupBy("bar_seq").agg((F.sum("pnl_points") > 0).alias("won"), F.max("entry_time").alias("entry_time"))
    of = lambda keys: d.join(keys.select("bar_seq").distinct(), "bar_seq", "left_semi")
    latest = won.orderBy(F.col("entry_time").desc()).limit(PER_TRADE)
    sides = models.balanced_sample(won, "won", PER_SIDE, key="bar_seq")
    sample = models.random_sample(d.where("is_rth"), SAMPLE, key="bar_seq")
    found = {
        "trade_factors": learning.top_factors(learning.contributions(model, of(latest), names)).join(won, "bar_seq"),
        "class_factors": learning.class_factors(learning.contributions(model, of(sides), names), won.select("bar_seq", "won")),
        "global_factors": learning.global_factors(written(shapley.contributions(model, sample, names), "contributions")),
    }
    found = {k: written(v, k) for k, v in found.items()}
    lines = []
    for k, v in found.items():
        v.coalesce(1).write.mode("overwrite").json(f"{out}/{k}")
        lines.append(report(k.replace("_", " ").capitalize(), [r.asDict() for r in v.orderBy(*[c for c in ("entry_time", "rank") if c in v.columns] or ["feature"]).collect()]))
    tables.write_text(spark, "\n".join(lines), f"{out}/report.txt")
    return found


def report(title: str, rows: list[dict]) -> str:
    """A plain-text table: one row below another, or name and value of a single row."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    if not rows:
        return f"{title}\n{'-' * len(title)}\n(none)\n"
    if len(rows) == 1:
        body = [f"{k:<28}{show(v)}" for k, v in rows[0].items()]
    else:
        names = list(rows[0])
        wide = [max(len(n), *(len(show(r[n])) for r in rows)) for n in names]
        body = ["  ".join(n.ljust(w) for n, w in zip(names, wide, strict=True)), *("  ".join(show(r[n]).ljust(w) for n, w in zip(names, wide, strict=True)) for r in rows)]
    return "\n".join([title, "-" * len(title), *body, ""])


def signals(scored: DataFrame, rr: float = 1.5, threshold: float = 0.55, quality_threshold: float = 0.5) -> DataFrame:
    """(bar_seq, bar_time, close, rth, prob_long, prob_short, quality, signal, entry_price, sl_price, tp_price): what to do at each bar's close, without slippage."""
    rth, side = market.is_rth(F.col("bar_time")), backtest.signal(F.col("prob_long"), F.col("prob_short"), threshold)
    good = rth & (side != 0) & F.coalesce(F.col("quality") >= quality_threshold, F.lit(True))
    side = F.when(good, side).otherwise(0)
    stop = market.round_to_tick(market.clip(F.col("atr") * 1.5, 2.0, 8.0))
    level = lambda points: F.when(side != 0, F.col("close") + side * points)
    name = F.when(side == 1, "LONG").when(side == -1, "SHORT").otherwise("NO_TRADE")
    return scored.select("bar_seq", "bar_time", "close", rth.alias("rth"), "prob_long", "prob_short", "quality", F.coalesce(name, F.lit("NO_TRADE")).alias("signal"), F.when(side != 0, F.col("close")).alias("entry_price"), level(-stop).alias("sl_price"), level(stop * rr).alias("tp_price"))


def live_signals(kept: dict[str, PipelineModel], names: list[str], ticks: DataFrame, window: str = "1min", **rules) -> DataFrame:
    """The signals of all bars of some ticks, the newest and unfinished one too."""
    width = width_of(window)
    return bar_signals(kept, names, bars.sequence(bars.time_bars(ticks, width, start=bars.anchor(ticks, width))), **rules)


def bar_signals(kept: dict[str, PipelineModel], names: list[str], b: DataFrame, **rules) -> DataFrame:
    """The signals of bars with bar_seq; a cvd that they have is taken."""
    f = written(features.second_generation(written(b, "live-bars")), "live-features")
    return written(signals(learning.scored(kept, names, f), **rules), "live-signals")


def viewer(spark: SparkSession, trades: DataFrame, d: DataFrame, out: str) -> None:
    """Bars as 60-byte records, trades as JSON."""
    tables.write_bar_files(d, f"{out}/bars")
    tables.write_trades_json(trades, f"{out}/trades")
