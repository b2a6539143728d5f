"""A file that grows between two runs of a stream is read on from where it was."""

import numpy as np
import pandas as pd

from tickforge.plans import learning
from tickforge.sources import binary
from tickforge.streaming.growing import TickFolder


def records(first, n):
    k = np.arange(first, first + n)
    return binary.encode(binary.TICK, pd.DataFrame({"ticks": 638_397_504_000_000_000 + k * 10_000_000, "price": 100.0 + k, "level_low": 99.0 + k, "level_high": 100.0 + k, "txn_count": k + 1}))


def test_appended_records_are_read_once(spark, tmp_path):
    spark.dataSource.register(TickFolder)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        s = spark.readStream.format("tick_folder").option("path", str(folder)).load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["source_file"], r["record_num"], r["txn_count"]) for r in spark.read.parquet(out).collect())

    (folder / "a.data").write_bytes(records(0, 3) + b"half")
    assert run() == [("a.data", i, i + 1) for i in range(3)]
    (folder / "a.data").write_bytes(records(0, 5))
    (folder / "b.data").write_bytes(records(0, 1))
    assert run() == [("a.data", i, i + 1) for i in range(5)] + [("b.data", 0, 1)]


def test_features_are_those_not_excluded(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0, "s", 4.0, 1.0)], "bar_seq long, close double, vwap double, name string, _tr double, atr_5 double")
    assert learning.feature_columns(d) == ["vwap", "atr_5"]
