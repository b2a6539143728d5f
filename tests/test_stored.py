"""Ticks in stored order: the same results as from any order, without an exchange of ticks, and without reading other sessions."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tickforge.operators import asof, bars, ordering
from tickforge.sources import events, stored


@pytest.fixture(scope="module")
def table(spark):
    t = events.decoded(spark, "/root/testdata/sf0.01")
    stored.store_ticks(t, "stored_ticks", buckets=6)
    yield t
    spark.sql("DROP TABLE stored_ticks")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(names).collect())


def test_running_sums_and_bars_without_an_exchange_of_ticks(spark, table):
    s = stored.read_stored(spark, "stored_ticks")
    assert s.count() == table.count()
    # Totals of blocks are broadcast; nothing is dealt by a hash of the block.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    run = stored.running(s, {"cvd": F.col("volume_delta")})
    assert not re.search(r"Exchange hashpartitioning\(\S*block", plan_of(run)) and "Bucketed: true" in plan_of(run)
    names = ["record_num", "ts", "cvd"]
    want = ordering.prefix_sums(table, ordering.time_block("ts"), ["ts", "record_num"], {"cvd": F.col("volume_delta")})
    assert rows(run, names) == rows(want, names)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    b, want = stored.stored_bars(s, "1 hour"), bars.time_bars(table, "1 hour")
    plan = plan_of(b)
    # One exchange: partial bars by their bar.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan
    names = sorted(want.columns)
    assert set(b.columns) == set(names) and rows(b, names) == rows(want, names)


def test_other_sessions_are_not_read(spark, table):
    low, high = datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 11, 6)
    some = stored.read_stored(spark, "stored_ticks", low, high)
    assert rows(some, ["record_num", "ts"]) == rows(table.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))), ["record_num", "ts"]) != []
    assert "PartitionFilters: [isnotnull(session_date" in plan_of(some) and "PushedFilters: [IsNotNull(ts)" in plan_of(some)
    files = lambda d: len(d.select(F.input_file_name()).distinct().collect())
    assert files(some) <= 3 * 6 < files(stored.read_stored(spark, "stored_ticks"))
    # A day more is added to the table as it is.
    more = table.limit(10).withColumn("session_date", F.lit(datetime.date(2030, 1, 1)))
    stored.store_ticks(more, "stored_ticks", buckets=6, mode="append")
    assert spark.table("stored_ticks").where("session_date = DATE '2030-01-01'").count() == 10


def test_asof_without_an_exchange_of_ticks(spark, table):
    left, right = table.where("record_num % 7 = 3"), table.where("record_num % 11 = 5").select("ts", "record_num", "price", "session_date")
    stored.store_ticks(left, "stored_left", buckets=6)
    stored.store_ticks(right, "stored_right", buckets=6)
    a, b = (stored.read_stored(spark, t) for t in ("stored_left", "stored_right"))
    try:
        for how in ("backward", "forward", "nearest"):
            got, want = stored.asof_stored(a, b, how), asof.asof_join(left, right, "ts", "ts", how, tie="record_num")
            pick = lambda d: sorted(tuple(str(x) for x in r) for r in d.select("record_num", "ts", "match.record_num", "match.price").collect())
            assert pick(got) == pick(want) != []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        plan = plan_of(stored.asof_stored(a, b))
        assert not re.search(r"Exchange hashpartitioning\(_block", plan), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_left")
        spark.sql("DROP TABLE stored_right")
