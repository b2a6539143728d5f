"""The source that splits tick files: the rows of the whole-file reader, in many tasks, with ranges left out by time."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.sources import binary, splits

START = 638_397_504_000_000_000  # 2024-01-02


def written_file(path, first, n, step=10_000_000, shuffled=False):
    k = np.arange(first, first + n)
    if shuffled:
        np.random.default_rng(1).shuffle(k)
    side = np.where(k % 3 == 0, 1.0, 0.0)
    path.write_bytes(binary.encode(binary.TICK, pd.DataFrame({"ticks": START + k * step + k % 7, "price": 100.0 + k % 9, "level_low": 100.0 + k % 9 - side, "level_high": 101.0 + k % 9 - side, "txn_count": k % 50 + 1, "flag": 1})) + b"half a record")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("ticks")
    (out / "more").mkdir()
    written_file(out / "a.data", 0, 10_000)
    written_file(out / "more" / "b.data", 10_000, 777)
    written_file(out / "odd.data", 20_000, 5000, shuffled=True)
    (out / "empty.data").write_bytes(b"")
    (out / "short.data").write_bytes(b"x" * 56)
    (out / "readme.txt").write_bytes(b"no ticks")
    return out


def paths_of(folder):
    return [str(folder / "a.data"), str(folder / "more"), str(folder / "odd.data"), str(folder / "empty.data"), str(folder / "short.data")]


def test_rows_are_those_of_the_whole_file_reader(spark, folder):
    got = splits.read_ticks(spark, paths_of(folder), span=999)
    want = binary.read_ticks(spark, [str(folder / "a.data"), str(folder / "more" / "b.data"), str(folder / "odd.data")])
    assert set(got.columns) == set(want.columns)
    own = sorted(want.columns)
    assert got.count() == 15_777 and got.select(own).exceptAll(want.select(own)).isEmpty() and want.select(own).exceptAll(got.select(own)).isEmpty()
    # One file in many tasks.
    assert got.rdd.getNumPartitions() == 11 + 1 + 6
    assert splits.read_ticks(spark, f"file://{folder}", span=5000).count() == 15_777


@pytest.mark.parametrize("kind", ["none", "ordered", "index"])
def test_filters_on_time_leave_ranges_out(spark, folder, tmp_path, kind):
    paths = paths_of(folder)[:2] if kind == "ordered" else paths_of(folder)
    index = None
    if kind == "index":
        index = f"file://{tmp_path}/index"
        table = splits.write_index(spark, paths, index, span=500)
        assert table.count() == 20 + 2 + 10 and table.where("low > high").isEmpty()
    how = {"span": 500, "ordered": kind == "ordered", "index": index}
    every = splits.read_ticks(spark, paths, span=500)
    low, high = datetime.datetime(2024, 1, 2, 1, 0), datetime.datetime(2024, 1, 2, 1, 10)
    some = splits.read_ticks(spark, paths, low, high, **how)
    want = every.where((F.date_format("ts", "HH:mm") >= "01:00") & (F.date_format("ts", "HH:mm") < "01:10"))
    assert some.count() == 600 and some.exceptAll(want).isEmpty() and want.exceptAll(some).isEmpty()
    left_out, n = splits.skipped(paths, low, high, **how)
    assert some.rdd.getNumPartitions() == n - left_out and (left_out > n - 15) == (kind != "none")
    # Open ends, and a span that nothing is in.
    assert splits.read_ticks(spark, paths, until=datetime.datetime(2024, 1, 2, 0, 0, 10), **how).count() == 10
    last = datetime.datetime(2024, 1, 2, 2, 30)
    assert splits.read_ticks(spark, paths, last, **how).count() == every.where(F.col("ts") >= F.lit(last)).count() > 0
    assert splits.read_ticks(spark, paths, datetime.datetime(2025, 1, 1), **how).count() == 0
    # A frame is read again whatever it was filtered by before.
    assert some.where("price < 0").count() == 0 and some.count() == 600
    if kind == "index":
        # An index of a file as it was before says nothing of it now.
        written_file(folder / "more" / "b.data", 30_000, 900)
        assert splits.read_ticks(spark, paths, datetime.datetime(2024, 1, 2, 8, 20), **how).count() == 900
        written_file(folder / "more" / "b.data", 10_000, 777)


def test_a_large_file_is_many_small_tasks(spark, tmp_path):
    """Two million records (114 MB), of which a minute is read: one task of its range."""
    written_file(tmp_path / "big.data", 0, 2_000_000, step=100_000)
    path = str(tmp_path / "big.data")
    t = splits.read_ticks(spark, path, span=50_000)
    assert t.rdd.getNumPartitions() == 40
    minute = splits.read_ticks(spark, path, datetime.datetime(2024, 1, 2, 2, 0), datetime.datetime(2024, 1, 2, 2, 1), span=50_000, ordered=True)
    assert minute.count() == 6000 and minute.rdd.getNumPartitions() == 1
    assert t.agg(F.sum("txn_count")).first()[0] == binary.read_ticks(spark, path).agg(F.sum("txn_count")).first()[0]
