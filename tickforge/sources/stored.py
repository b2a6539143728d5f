"""Ticks stored in the order that is asked for: a table by session, bucketed by block of time and sorted within, for running sums and bars without a shuffle.

A block of time lies in one bucket, and a bucket's files of a session are one task's, in order.  Windows and groups by block are met by the
layout, so running sums need no exchange of ticks, and neither do partial bars; only totals of blocks move.  Sessions that a filter
leaves out aren't read, and in those that are, row groups of other times are left out by their statistics.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.market import session_date
from tickforge.operators import asof, partial
from tickforge.operators.ordering import BLOCK_SECONDS, prefix_sums, time_block

#: Buckets of a table: tasks of a pass over it, whatever the number of sessions.
BUCKETS = 64
BLOCK = "tick_block"


def store_ticks(ticks: DataFrame, table: str, buckets: int = BUCKETS, block_seconds: int = BLOCK_SECONDS, mode: str = "overwrite") -> None:
    """Write ticks (ts, record_num, session_date and more) as a table of the catalog: one shuffle, a file for each bucket of a session."""
    t = ticks.withColumn(BLOCK, time_block("ts", block_seconds))
    # The same hash as the buckets', so a task has one bucket.
    t = t.repartition(buckets, BLOCK).sortWithinPartitions("session_date", BLOCK, "ts", "record_num")
    t.write.mode(mode).partitionBy("session_date").bucketBy(buckets, BLOCK).sortBy(BLOCK, "ts", "record_num").saveAsTable(table)


def read_stored(spark: SparkSession, table: str, since: datetime.datetime | None = None, until: datetime.datetime | None = None) -> DataFrame:
    """Ticks of times from since to before until; only the sessions that they fall in are read."""
    d = spark.table(table)
    if since:
        d = d.where((F.col("session_date") >= session_date(F.lit(since).cast("timestamp_ntz"))) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    if until:
        d = d.where((F.col("session_date") <= session_date(F.lit(until).cast("timestamp_ntz"))) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return d


def running(stored: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Stored ticks with running totals in the order of ts and record_num."""
    return prefix_sums(stored, F.col(BLOCK), ["ts", "record_num"], sums)


def stored_bars(stored: DataFrame, width: str, start: str | None = None) -> DataFrame:
    """What time_bars gives of stored ticks; their blocks are the slices, and only partial bars are shuffled."""
    return partial.merged(partial.partial_bars(stored, width, start, by=(BLOCK,)), width).drop("overlaps")


def asof_stored(left: DataFrame, right: DataFrame, how: str = "backward") -> DataFrame:
    """asof_join by ts of two tables that were stored with as many buckets and blocks as long: windows are over blocks, which lie in one task already.

    Of right rows at one time the last, or first, by record_num matches.
    """
    return asof.asof_join(left, right, "ts", "ts", how, tie="record_num", block=BLOCK)
