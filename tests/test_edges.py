"""Queries against their SQL on small tables whose figures have no rows to be made of, or no spread."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tickforge.functions import market
from tickforge.operators import backtest
from tickforge.plans import queries as q

T0 = datetime(2024, 1, 1)


@pytest.fixture
def compare(spark, tmp_path):
    """Writes (seconds, event_type, k) as events and gives a query's rows from Spark and from DuckDB, with NULL and NaN told apart."""

    def written(rows):
        d = [(i, T0 + timedelta(seconds=s), 1, kind, 1.0, f'{{"k": {k}}}') for i, (s, kind, k) in enumerate(rows)]
        kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        spark.createDataFrame(d, kinds).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")

        def both(name):
            got = q.QUERIES[name](spark, str(tmp_path))
            sql = con.execute(q.SQL[name])
            at = [[c[0] for c in sql.description].index(c) for c in got.columns]
            return [sorted(repr(dict(zip(got.columns, r, strict=True))) for r in rows) for rows in (map(tuple, got.collect()), [tuple(r[i] for i in at) for r in sql.fetchall()])]

        return both

    return written


def test_contrast_without_winners(compare):
    """Prices that only fall have losers alone."""
    falling = compare([(3600 * i + 60 * j, "click", k) for i in range(30) for j, k in enumerate((0, 9 + i % 3, 18))])
    got, want = falling("winner_loser_factors")
    assert got == want and len(got) == 6 and all("None" in r for r in got)


def even(n=40):
    """Hours of some trades with one of 100 each, so that the largest is always the same and all else varies."""
    return [(3600 * i + 60 * j, "signup" if (i + j * j) % 3 else "view", (i * i + 7 * j) % 97 if j else 99) for i in range(n) for j in range(3 + i % 4)]


def test_feature_that_never_changes(compare):
    """Its correlation is NaN, which SQL ranks before all others."""
    got, want = compare(even())("effect_correlation")
    assert got == want and len(got) == 6 and "nan" in got[0]


def test_top_features_with_one_that_never_changes(compare):
    got, want = compare(even())("top_k_importance")
    assert got == want and len(got) == 3 and sum("nan" in r for r in got) == 1


def hourly(*sides):
    """Six ticks a half hour from 14:30, which is 9:30 in New York; k moves the price."""
    return [(52_200 + 1800 * i + 300 * j, *side) for i, side in enumerate(sides) for j in range(6)]


QUIET = ("error", 4)
DAYS = {
    "no trade": hourly(*[QUIET] * 12),
    "one that wins": hourly(("signup", 4), ("error", 8), ("error", 8), ("error", 8), QUIET, QUIET),
    "one that loses": hourly(("signup", 4), ("error", 0), ("error", 0), ("error", 0), QUIET, QUIET),
    "a short that wins": hourly(("click", 4), ("error", 0), ("error", 0), ("error", 0), QUIET, QUIET),
    "two that lose": hourly(("signup", 4), ("error", 0), ("error", 0), ("signup", 4), ("error", 0), ("error", 0), QUIET),
}


@pytest.mark.parametrize("day", DAYS)
def test_figures_that_are_not_defined(compare, day):
    """No trades, no winners, no losers, one side alone, a single trade."""
    got, want = compare(DAYS[day])("backtest_metrics")
    assert got == want and ("'n_trades': 0," in got[0]) == (day == "no trade")


def test_figures_keep_the_stand_ins_of_a_report(spark):
    kinds = "exit_time timestamp_ntz, entry_time timestamp_ntz, direction string, pnl_dollars double, pnl_points double, bars_held int"
    of = lambda *p: backtest.metrics(spark.createDataFrame([(T0 + timedelta(hours=i), T0, "LONG", x, x / 50, 1) for i, x in enumerate(p)], kinds)).first().asDict()
    assert set(of().values()) == {0}
    won, lost = of(45.0, 45.0), of(-55.0)
    assert (won["profit_factor"], won["avg_loser"], won["sharpe_approx"], won["short_win_rate"]) == (float("inf"), 1, 0, 0)
    assert (lost["profit_factor"], lost["avg_loser"], lost["avg_winner"], lost["win_rate"]) == (0, 55, 0, 0)


def test_rounding_is_that_of_sql(spark):
    """Halves that a double can't hold, as shares of trades have."""
    pairs = [(k, n) for n in (320, 640, 1280, 3200) for k in range(n + 1)]
    got = q.rounded(spark.createDataFrame([(k, n, k / n) for k, n in pairs], "k int, n int, x double")).orderBy("n", "k").collect()
    want = duckdb.connect().execute("SELECT k, n, round(k::DOUBLE / n, 6) FROM (VALUES (320), (640), (1280), (3200)) t(n), range(3201) r(k) WHERE k <= n ORDER BY n, k").fetchall()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("day", ["no trade", "one that wins"])
def test_viewer_without_trades(compare, day):
    got, want = compare(DAYS[day])("viewer_stats")
    assert got == want and ("'wins': None" in got[0]) == (day == "no trade")


def test_totals_without_patterns(compare):
    got, want = compare(DAYS["no trade"])("pattern_totals")
    assert got == want and "'successes': None" in got[0]


def test_volume_labels_are_those_of_printf(spark):
    """Every volume halfway between two labels up to two millions, and some between and beyond."""
    v = [None, -5, 0, 999, *range(1000, 2_000_000, 50), *range(1001, 400_000, 37), 10**12 + 50, 123_456_789_050]
    got = spark.createDataFrame([(x,) for x in v], "v long").select("v", market.volume_label(F.col("v"))).collect()
    assert {r[0]: r[1] for r in got} == {x: f"{x / 1000:.1f}K" if x is not None and x >= 1000 else x if x is None else str(x) for x in v}


def test_labels_of_bars_halfway(compare):
    """Hours of 1,250, 43,650 and 1,150 trades: SQL has 1.2K, 43.6K and 1.1K."""
    hours = [(1250, 50), (43_650, 90), (1150, 50)]
    got, want = compare([(3600 * i + j, "view", k - 1) for i, (n, k) in enumerate(hours) for j in range(n // k)])("footprint_lookup")
    assert got == want and [r.count(x) for r, x in zip(got, ("1.2K", "43.6K", "1.1K"), strict=True)] == [1, 1, 1]


@pytest.mark.parametrize("hours", [0, 3, 8])
def test_top_features_of_few_rows(compare, hours):
    """SQL asks for no least number of rows: no pair at all is NULL, without spread it is NaN."""
    got, want = compare(even(hours))("top_k_importance")
    assert got == want and len(got) == 3


@pytest.mark.parametrize(("hours", "rows"), [(15, 0), (16, 6)])
def test_effects_ask_for_eleven_rows(compare, hours, rows):
    got, want = compare(even(hours))("effect_correlation")
    assert got == want and len(got) == rows
