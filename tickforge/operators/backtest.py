"""Event-driven backtest: exits of all candidates in parallel, then the greedy chain of those that are taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.market import COMMISSION, POINT_VALUE, SLIPPAGE_TICKS, TICK_SIZE, clip, is_rth, is_session_end, round_to_tick, trade_result

from .chain import greedy_chain
from .ordering import LANE, margin_window, own_rows, prefix_max, prefix_sums, with_margin

SLIP = SLIPPAGE_TICKS * TICK_SIZE


def signal(prob_long: Column, prob_short: Column, threshold: float = 0.55) -> Column:
    return F.when((prob_long > threshold) & (prob_long > prob_short), 1).when((prob_short > threshold) & (prob_short > prob_long), -1).otherwise(0)


def _exit(path: Column, side: Column, entry: Column, stop: Column, target: Column, max_hold: int) -> Column:
    """Fold the bars after the entry into (done, reason, price, seq, time, held, mae, mfe)."""
    start = F.struct(F.lit(False).alias("done"), F.lit("END").alias("reason"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit(0).alias("held"), F.lit(0.0).alias("mae"), F.lit(0.0).alias("mfe"))

    def step(a: Column, bar: Column) -> Column:
        long = side == 1
        good = F.when(long, bar["high"] - entry).otherwise(entry - bar["low"])
        bad = F.when(long, entry - bar["low"]).otherwise(bar["high"] - entry)
        lost = F.when(long, bar["low"] <= stop).otherwise(bar["high"] >= stop)
        won = F.when(long, bar["high"] >= target).otherwise(bar["low"] <= target)
        late = a["held"] + 1 >= max_hold
        new = F.struct(
            (lost | won | bar["closing"] | late).alias("done"),
            F.when(lost, "SL").when(won, "TP").when(bar["closing"], "EOD").when(late, "TIMEOUT").otherwise("END").alias("reason"),
            F.when(lost, stop).when(won, target).otherwise(bar["close"]).alias("price"),
            bar["bar_seq"].alias("seq"),
            bar["bar_time"].alias("time"),
            (a["held"] + 1).alias("held"),
            F.greatest(a["mae"], bad).alias("mae"),
            F.greatest(a["mfe"], good).alias("mfe"),
        )
        return F.when(a["done"], a).otherwise(new)

    return F.aggregate(path, start, step)


def candidates(scored: DataFrame, rr: float = 1.5, threshold: float = 0.55, quality_threshold: float = 0.5, max_hold: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Every bar at which a flat trader would enter, with the exit of that entry.

    scored has bar_seq, bar_time, high, low, close, prob_long, prob_short, quality (NULL: no filter) and atr (the predicted one).
    Of several instruments, named by the columns `by`, bar_seq has lanes.
    """
    d = with_margin(scored.withColumn("_closing", is_session_end(F.col("bar_time"))), "bar_seq", 0, max_hold)
    d = d.withColumn("_path", F.collect_list(F.struct("bar_seq", "bar_time", "high", "low", "close", F.col("_closing").alias("closing"))).over(margin_window().rowsBetween(1, max_hold)))
    d = own_rows(d).withColumn("direction", signal(F.col("prob_long"), F.col("prob_short"), threshold))
    d = d.where((F.col("direction") != 0) & is_rth(F.col("bar_time")) & ~F.col("_closing") & F.coalesce(F.col("quality") >= quality_threshold, F.lit(True)))
    side = F.col("direction")
    d = d.withColumn("sl_points", round_to_tick(clip(F.col("atr") * 1.5, 2.0, 8.0))).withColumn("entry_price", F.col("close") + side * SLIP)
    d = d.withColumns({"sl_price": F.col("entry_price") - side * F.col("sl_points"), "tp_price": F.col("entry_price") + side * F.col("sl_points") * rr})
    d = d.withColumn("x", _exit(F.col("_path"), side, F.col("entry_price"), F.col("sl_price"), F.col("tp_price"), max_hold))
    ended = ~F.col("x.done")
    exit_price = F.when(ended, F.coalesce("x.price", "close")).otherwise(F.col("x.price") - side * SLIP)
    d = d.withColumns({"exit_price": exit_price, "exit_reason": F.col("x.reason"), "exit_seq": F.coalesce("x.seq", "bar_seq"), "exit_time": F.coalesce("x.time", "bar_time"), "bars_held": F.col("x.held"), "mae": F.col("x.mae"), "mfe": F.col("x.mfe")})
    d = d.withColumn("pnl_points", (F.col("exit_price") - F.col("entry_price")) * side)
    d = d.withColumn("pnl_dollars", F.col("pnl_points") * POINT_VALUE - 2 * COMMISSION)
    d = d.withColumn("next_free", F.when(F.col("exit_reason") != "END", F.col("exit_seq")))
    return d.select(*by, "bar_seq", F.col("bar_time").alias("entry_time"), "exit_time", F.when(side == 1, "LONG").otherwise("SHORT").alias("direction"), "entry_price", "exit_price", "sl_price", "tp_price", "exit_reason", "pnl_points", "pnl_dollars", "bars_held", "mae", "mfe", "exit_seq", "next_free")


def trades(scored: DataFrame, by: Sequence[str] = (), **rules) -> DataFrame:
    """The trades of one position at a time (of each instrument); after an exit the same bar may enter again."""
    return greedy_chain(candidates(scored, by=by, **rules), "bar_seq", "next_free", lane=LANE if by else None)


def equity_curve(bars: DataFrame, taken: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(bar_time, equity) a bar, after the columns `by`: dollars of the trades closed by then.  A position open at the end isn't in it."""
    closed = taken.where("exit_reason <> 'END'").groupBy(F.col("exit_seq").alias("s")).agg(F.sum("pnl_dollars").alias("pnl"))
    d = bars.select(*by, "bar_seq", "bar_time").join(closed, F.col("bar_seq") == F.col("s"), "left")
    return prefix_sums(d, F.to_date("bar_time"), ["bar_time"], {"equity": F.coalesce("pnl", F.lit(0.0))}, by).select(*by, "bar_time", "equity")


def drawdown(taken: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """trades with cum_pnl, peak (which starts at the first trade's, not at 0) and drawdown, by exit and then entry time."""
    block, order = F.to_date("exit_time"), ["exit_time", "entry_time"]
    d = prefix_sums(taken, block, order, {"cum_pnl": F.col("pnl_dollars")}, by)
    return prefix_max(d, block, order, "peak", F.col("cum_pnl"), by).withColumn("drawdown", F.col("peak") - F.col("cum_pnl"))


def figures(taken: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of performance figures, or a row an instrument that has trades; those that aren't defined are NULL.

    The Sharpe ratio of trades that are all alike is infinite, or NaN if they bring nothing.
    """
    p = F.col("pnl_dollars")
    win, loss = p > 0, p < 0
    share = lambda d: F.avg(F.when(F.col("direction") == d, win.cast("double"))).alias(f"{d.lower()}_win_rate")
    mean, spread = F.avg(p), F.stddev_pop(p)
    alike = F.when(spread.isNotNull(), F.when(mean == 0, float("nan")).otherwise(F.signum(mean) * float("inf")))
    return drawdown(taken, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.try_divide(F.sum(F.when(win, p)), F.abs(F.sum(F.when(loss, p)))).alias("profit_factor"),
        F.avg(F.when(win, p)).alias("avg_winner"),
        F.abs(F.avg(F.when(loss, p))).alias("avg_loser"),
        mean.alias("expectancy"),
        F.sum(p).alias("total_pnl"),
        F.sum("pnl_points").alias("total_points"),
        F.max("drawdown").alias("max_drawdown"),
        F.when(spread > 0, mean / spread * (252 * 4) ** 0.5).otherwise(alike).alias("sharpe_approx"),
        F.avg("bars_held").alias("avg_bars_held"),
        F.count_if(F.col("direction") == "LONG").alias("n_longs"),
        F.count_if(F.col("direction") == "SHORT").alias("n_shorts"),
        share("LONG"),
        share("SHORT"),
    )


def metrics(taken: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """figures with stand-ins for what isn't defined: all zero if there are no trades, a profit factor of infinity and a loser of 1 without losers, else zero."""
    f = figures(taken, by)
    none, lost = F.col("n_trades") == 0, F.col("avg_loser").isNotNull()
    stands = {"profit_factor": F.when(none | lost, 0.0).otherwise(float("inf")), "avg_loser": F.when(none, 0.0).otherwise(1.0)}
    finite = F.when(F.abs("sharpe_approx") < float("inf"), F.col("sharpe_approx"))
    filled = {c: F.coalesce(F.col(c), stands.get(c, F.lit(0.0))) for c, t in f.dtypes if t == "double" and c not in by}
    return f.withColumns(filled | {"sharpe_approx": F.coalesce(finite, F.lit(0.0))})


#: A viewer's filters.  Whatever isn't a win counts as a loss there.
FILTERS = ("all", "win", "loss", "long", "short")


def viewer_filter(taken: DataFrame, which: str) -> DataFrame:
    """The trades that a viewer shows."""
    win = trade_result(F.col("pnl_points")) == "WIN"
    rule = {"all": F.lit(True), "win": win, "loss": ~win, "long": F.col("direction") == "LONG", "short": F.col("direction") == "SHORT"}
    return taken.where(rule[which])


def viewer_stats(taken: DataFrame) -> DataFrame:
    """One row: trades, wins, losses (not wins), their counts strictly, win rate, profit factor and mean points."""
    p = F.col("pnl_points")
    win = p > 0
    won, lost = F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)), F.coalesce(F.abs(F.sum(F.when(~win, p))), F.lit(0.0))
    n = F.count(F.lit(1))
    return taken.agg(
        n.alias("n"), F.count_if(win).alias("wins"), F.count_if(~win).alias("losses"), F.count_if(p < 0).alias("strict_losses"), F.count_if(p == 0).alias("scratches"),
        F.coalesce(F.try_divide(F.count_if(win).cast("double"), n.cast("double")), F.lit(0.0)).alias("win_rate"), F.try_divide(won, lost).alias("profit_factor"),
        F.coalesce(F.avg(F.when(win, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~win, p)), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum(p), F.lit(0.0)).alias("total_points"),
    )


def exit_reasons(taken: DataFrame) -> DataFrame:
    return taken.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))


def pnl_curve(taken: DataFrame) -> DataFrame:
    return prefix_sums(taken, F.to_date("exit_time"), ["exit_time", "entry_time"], {"equity_points": F.col("pnl_points")}).select("entry_time", "exit_time", "equity_points")
