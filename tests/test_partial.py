"""Partial bars that merge, against bars made in one go; and bars of files of which only the changed ones are decoded."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.operators import bars, partial
from tickforge.sources import binary, filebars

START = 638_397_504_000_000_000  # 2024-01-02


def ticks_of(spark, n, seed, sides=(1, 1, 1, -1, 0)):
    r, at, rows, side = random.Random(seed), 0, [], 1
    for i in range(n):
        at += r.choice((0, 1, 5, 40))
        side = side if r.random() < 0.7 else r.choice(sides)
        rows.append((i, pd.Timestamp("2024-01-02") + pd.Timedelta(seconds=at), 100.0 + r.randint(0, 9), r.randint(1, 50), side, 100.0, 100.0 + r.choice((1, 2))))
    return spark.createDataFrame([(a, b.to_pydatetime(), *c) for a, b, *c in rows], "record_num long, ts timestamp_ntz, price double, txn_count long, direction int, level_low double, level_high double")


def same(a, b):
    assert set(a.columns) == set(b.columns)
    names = sorted(a.columns)
    show = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in d.select(names).collect())
    assert show(a) == show(b)


@pytest.mark.parametrize("width", ["1 day", "1 hour", "7 minutes"])
def test_slices_of_a_bar_merge(spark, width):
    """Runs go on over slices of a minute, some of them whole slices of one direction."""
    for seed, sides in ((1, (1, 1, 1, -1, 0)), (2, (1,)), (3, (1, -1))):
        t = ticks_of(spark, 1500, seed, sides)
        same(partial.sliced_bars(t, width, slice_seconds=60), bars.time_bars(t, width))


def test_a_hot_bar_is_many_tasks(spark):
    """A bar of a day and a million ticks: no task of the shuffle holds a tenth of them."""
    t = spark.range(1_000_000).selectExpr("id AS record_num", "timestamp_ntz '2024-01-02' + make_dt_interval(0, 0, 0, id * 0.08) AS ts", "100.0D + id % 7 AS price", "id % 9 + 1 AS txn_count", "CAST(if(id % 1000 < 600, 1, -1) AS INT) AS direction", "100.0D AS level_low", "101.0D AS level_high")
    parts = partial.partial_bars(t, "1 day")
    sizes = [r["n"] for r in parts.select("n").collect()]
    assert len(sizes) == 267 and max(sizes) < 4000 and sum(sizes) == 1_000_000
    b = partial.merged(parts, "1 day").first()
    assert (b["max_buy_run"], b["max_sell_run"], b["num_events"]) == (600, 400, 1_000_000)


def put(path, first, n, seed):
    r = random.Random(seed)
    rows = [(START + (first + k) * 10_000_000, p := 100.0 + r.randint(0, 5), p - (r.random() < 0.6), p + 1.0, r.randint(1, 9)) for k in range(n)]
    path.write_bytes(binary.encode(binary.TICK, pd.DataFrame(rows, columns=["ticks", "price", "level_low", "level_high", "txn_count"])))


def test_only_changed_files_are_decoded(spark, tmp_path):
    folder, store = tmp_path / "ticks", f"{tmp_path}/store"
    folder.mkdir()
    # Files that meet inside a bar, one that overlaps another, and one without records.
    put(folder / "a.data", 0, 1000, 1)
    put(folder / "b.data", 1000, 1000, 2)
    put(folder / "c.data", 1500, 300, 3)
    (folder / "none.data").write_bytes(b"")
    whole = lambda: bars.time_bars(binary.read_ticks(spark, str(folder), glob="*.data"), "10 minutes")
    at = (str(folder), "10 minutes", store)
    assert len(filebars.missing(spark, *at)) == 3
    names = [c for c in bars.time_bars(ticks_of(spark, 5, 1), "1 hour").columns]
    got = filebars.file_bars(spark, *at, span=300)
    # Record numbers tie within overlapping files of one second, so what depends on their order is left to the bars that don't overlap.
    sure = [c for c in names if c not in ("open", "close", "max_buy_run", "max_sell_run")]
    same(got.select(sure), whole().select(sure))
    clear = F.col("bar_time") != F.lit("2024-01-02 00:20:00").cast("timestamp_ntz")
    same(got.where(clear), whole().where(clear))
    assert filebars.missing(spark, *at) == []
    put(folder / "b.data", 1000, 1200, 4)
    put(folder / "d.data", 5000, 50, 5)
    assert sorted(x.rsplit("/", 1)[1] for x in filebars.missing(spark, *at)) == ["b.data", "d.data"]
    got = filebars.file_bars(spark, *at)
    same(got.select(sure), whole().select(sure))
    assert spark.read.parquet(store).select("file").distinct().count() == 5 and filebars.sweep(spark, *at) == 1
    (folder / "c.data").unlink()
    same(filebars.file_bars(spark, *at), whole())
    with pytest.raises(ValueError, match="no records"):
        filebars.file_bars(spark, str(folder / "none.data"), "10 minutes", store)
