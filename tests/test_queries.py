"""Every query with SQL against DuckDB on the smallest tables, and none of them empty by accident."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tickforge.plans import queries as q

DIR = "/root/testdata/sf0.001"
#: So small a sample has no pattern.
MAY_BE_EMPTY = {"pattern_events", "breakout_vwap_position", "balanced_sample", "walk_forward_folds", "consolidation_zones", "zone_summary", "volume_profile", "volume_profile_metrics", "level_class"}
CHOSEN = ["bars_ohlcv", "bars_flow", "bars_max_run", "bars_cvd", "bars_cvd_viewer", "footprint_diagonal", "microstructure", "multi_timeframe", "triple_barrier", "trade_labels", "forward_labels", "backtest_trades", "asof_nearest", "asof_forward", "first_touch_ticks", "rth_mask"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        df[c] = df[c].map(lambda v: "-" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, duck, name):
    got = q.QUERIES[name](spark, DIR).toPandas()
    assert plain(got) == plain(duck.execute(q.SQL[name]).df())
    assert len(got) or name in MAY_BE_EMPTY


def test_registry_is_whole():
    assert set(q.SQL) <= set(q.QUERIES) <= set(entry.queries())
    assert set(q.QUERIES) == set(q.SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
