"""Commands over files: `python -m tickforge COMMAND ...`.

ticks, minutes: show, summarise or export a binary file.  features: a feature matrix.  charts: the tables of a chart.  patterns: events and hit rates.
train: the models of a generation.  predict: the first generation's predictions.  backtest, explain, viewer, live: what the second generation's models are used for.
run-trading, run-all: the two chains of these as one command.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickforge.operators import bars, models, patterns
from tickforge.plans import learning, workflow
from tickforge.sources import binary, tables
from tickforge.sources.scratch import written
from tickforge.streaming import live, state
from tickforge.streaming.growing import TickFolder


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickforge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **flags):
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for flag, default in flags.items():
            kind = {"type": type(default)} if default is not None and not isinstance(default, bool) else {}
            c.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if isinstance(default, bool) else {"default": default, **kind}))
        return c

    for name in ("ticks", "minutes"):
        command(name, "input_file", all=False, csv=None, summary=False).add_argument("-n", "--limit", type=int, default=50)
    command("features", "data_dir", window="1min", horizon="5min", output="features.parquet")
    command("charts", "input_file", interval="1min").add_argument("-o", "--output", required=True)
    c = command("patterns", min_consol=5, max_consol=10, min_vol=2000.0, min_balance=0.4, min_body=4.0, max_retrace_bars=5, min_retrace=0.5, target_ticks=50, stop_ticks=20, window="1min", cache_dir=None, no_cache=False)
    c.add_argument("input_paths", nargs="+")
    c.add_argument("-o", "--output")
    c = command("train", "data", window="1min", horizon="5min", rr=1.5, max_hold=60, folds=5, trees=20)
    c.add_argument("--generation", type=int, choices=(1, 2), default=2)
    c.add_argument("--output-dir", required=True)
    command("predict", "data_dir", window="1min", horizon="5min", output=None, tail=20).add_argument("--models-dir", required=True)
    trading = {"rr": 1.5, "signal_threshold": 0.55, "quality_threshold": 0.5}
    c = command("backtest", "models_dir", features=None, data=None, window="1min", max_hold=60, **trading)
    c.add_argument("--output", required=True)
    for name in ("explain", "viewer"):
        c = command(name, "models_dir")
        for flag in ("--features", "--trades", "--output"):
            c.add_argument(flag, required=True)
    c = command("live", "models_dir", window="1min", tail=30, work=None, once=False, late="1min", **trading)
    either = c.add_mutually_exclusive_group(required=True)
    either.add_argument("--watch", help="a folder of growing binary files")
    either.add_argument("--file", help="a binary file to replay")
    # What may be left out has the defaults of the chains; results go to `models` under the data unless said otherwise.
    for name, positional in (("run-trading", {"data": "data", "window": "1min", "rr": "1.5", "max_hold": "60", "folds": "5"}), ("run-all", {"data": ".", "window": "1min", "horizon": "5min"})):
        c = command(name, trees=20, output=None)
        for x, default in positional.items():
            c.add_argument(x, nargs="?", default=default)
    return p


def matrix(spark: SparkSession, path: str, a: argparse.Namespace):
    """A feature matrix: read if path is a table, made if it is a folder of binary files."""
    if path.rstrip("/").endswith((".parquet", ".csv")):
        return tables.read_table(spark, path)
    binary.required(spark, path)
    of = vars(a)
    return workflow.feature_matrix(binary.read_ticks(spark, path, glob="*.data"), a.window, of.get("horizon", "5min"), float(of.get("rr", 1.5)), int(of.get("max_hold", 60)))


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    if a.command in ("run-trading", "run-all") and not a.output:
        a.output = f"{a.data.rstrip('/')}/models"
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("ticks", "minutes"):
        d = bars.session_cvd(binary.read_ticks(spark, a.input_file)) if a.command == "ticks" else binary.read_minute_bars(spark, a.input_file)
        if a.csv:
            (tables.write_ticks_csv if a.command == "ticks" else tables.write_bars_csv)(d, a.csv)
        elif a.summary:
            (bars.tick_summary(d) if a.command == "ticks" else bars.bar_summary(d.withColumnsRenamed({"ts": "bar_time", "buy_count": "buy_volume", "sell_count": "sell_volume"}))).show(vertical=True, truncate=False)
        else:
            if a.all:
                # Row by row, a partition at a time on the driver.
                print("\t".join(d.columns))
                for row in tables.preview(d, limit=None).toLocalIterator():
                    print("\t".join(map(str, row)))
            else:
                tables.preview(d, limit=a.limit).show(a.limit, truncate=False)
    elif a.command == "features":
        tables.write_table(matrix(spark, a.data_dir, a), a.output)
    elif a.command == "charts":
        binary.required(spark, a.input_file, glob="*")
        t, width = binary.read_ticks(spark, a.input_file), workflow.width_of(a.interval)
        start = bars.anchor(t, width)
        for name, d in (("bars", bars.time_bars(t, width, runs=False, start=start)), ("cvd", bars.cvd_bars(t, width, start)), ("footprint", bars.footprint(t, width, start=start))):
            tables.write_table(d, f"{a.output}/{name}.parquet")
    elif a.command == "patterns":
        width = workflow.width_of(a.window)
        t = binary.ingest(spark, a.input_paths, a.cache_dir) if a.cache_dir and not a.no_cache else binary.read_ticks(spark, a.input_paths, strict=True, glob="*.data")
        t = written(patterns.tick_numbers(t), "pattern-ticks")
        events = patterns.pattern_events(written(bars.sequence(bars.time_bars(t, width)), "pattern-bars"), t, width, a.min_consol, a.max_consol, a.min_vol, a.min_balance, a.min_body, a.max_retrace_bars, a.min_retrace, a.target_ticks, a.stop_ticks)
        events = written(events, "pattern-events")
        patterns.pattern_totals(events).show(vertical=True)
        patterns.pattern_stats(events).orderBy("stratum", "category").show(100, truncate=False)
        if a.output:
            tables.write_table(events, a.output)
    elif a.command == "train":
        kinds = learning.FIRST if a.generation == 1 else learning.SECOND
        for kind, rows in workflow.train_all(matrix(spark, a.data, a), kinds, a.output_dir, a.folds, a.trees, rr=a.rr, max_hold=a.max_hold, window=a.window).items():
            print(workflow.report(kind, rows))
    elif a.command == "predict":
        kept, meta = learning.load(spark, a.models_dir)
        p = written(workflow.predictions(kept, meta["features"], matrix(spark, a.data_dir, a)), "predictions")
        p.orderBy(F.col("bar_time").desc()).limit(a.tail).orderBy("bar_time").show(a.tail, truncate=False)
        models.distribution(p, "signal").show()
        if a.output:
            tables.write_table(p, a.output)
    elif a.command == "backtest":
        kept, meta = learning.load(spark, a.models_dir)
        workflow.run_backtest(kept, meta["features"], matrix(spark, a.features or a.data, a), a.output, a.rr, a.signal_threshold, a.quality_threshold, a.max_hold)
        print(tables.read_text(spark, f"{a.output}/report.txt"))
    elif a.command == "explain":
        kept, meta = learning.load(spark, a.models_dir)
        workflow.explain(kept, meta["features"], tables.read_table(spark, a.features), tables.read_trades(spark, a.trades), a.output)
        print(tables.read_text(spark, f"{a.output}/report.txt"))
    elif a.command == "viewer":
        workflow.viewer(spark, tables.read_trades(spark, a.trades), tables.read_table(spark, a.features), a.output)
    elif a.command == "live":
        kept, meta = learning.load(spark, a.models_dir)
        rules = {"rr": a.rr, "threshold": a.signal_threshold, "quality_threshold": a.quality_threshold}
        if a.file:
            live.replay(workflow.live_signals(kept, meta["features"], binary.read_ticks(spark, a.file), a.window, **rules), a.tail).orderBy("bar_time").show(a.tail, truncate=False)
        else:
            spark.dataSource.register(TickFolder)
            stream = spark.readStream.format("tick_folder").option("path", a.watch).load()
            signal = lambda b: workflow.bar_signals(kept, meta["features"], b, **rules)
            state.watch(stream, signal, f"{a.work}/checkpoint", f"{a.work}/signals", workflow.width_of(a.window), workflow.duration(a.late), newest=True, once=a.once).awaitTermination()
    elif a.command == "run-trading":
        run_trading(spark, a)
    else:
        d = matrix(spark, a.data, a)
        tables.write_table(d, f"{a.output}/features.parquet")
        workflow.train_all(d, learning.FIRST, f"{a.output}/models", trees=a.trees)
        kept, meta = learning.load(spark, f"{a.output}/models")
        tables.write_table(workflow.predictions(kept, meta["features"], d), f"{a.output}/predictions.csv")


def run_trading(spark: SparkSession, a: argparse.Namespace) -> None:
    """Features, models, backtest, explanation and viewer files, one after another, under one folder."""
    d = matrix(spark, a.data, a)
    tables.write_table(d, f"{a.output}/features.parquet")
    workflow.train_all(d, learning.SECOND, f"{a.output}/models", int(a.folds), a.trees, rr=float(a.rr), max_hold=int(a.max_hold), window=a.window)
    kept, meta = learning.load(spark, f"{a.output}/models")
    workflow.run_backtest(kept, meta["features"], d, f"{a.output}/backtest", rr=float(a.rr), max_hold=int(a.max_hold))
    trades = tables.read_trades(spark, f"{a.output}/backtest/trades.csv")
    workflow.explain(kept, meta["features"], d, trades, f"{a.output}/explanation")
    workflow.viewer(spark, trades, d, f"{a.output}/viewer")


if __name__ == "__main__":
    main()
