"""Order over a whole table without gathering it in one task.

Rows are cut into blocks (some minutes of ticks, a day of bars, or so many bars); what a block needs of the others is either a
total, which is prefix-summed over the small table of blocks, or a margin of neighbours, which is copied.

Several instruments: totals are told apart by the columns `within`, and numbered rows of each instrument have a lane of
numbers to themselves, so that no block, and so no margin and no window of one, has rows of two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars in a block: far more than any look-back, and little for one task.
BLOCK = 20_000
#: Seconds and records of a block of ticks: a busy day is hundreds of tasks, and ten years are a million rows in the table of blocks.
BLOCK_SECONDS, BLOCK_RECORDS = 300, 500_000
#: Numbers of an instrument's lane: more than rows that it can have and a block.  Four million lanes stay under 2^62.
LANE = 1 << 40


def time_block(ts: str, seconds: int = BLOCK_SECONDS) -> Column:
    """The number of a time's block, which rises with time."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def prefix_sums(df: DataFrame, block: Column, order: Sequence[str], sums: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """df with the running total of each expression, over all rows (of equal columns `within`) in the order of block and then `order`.

    block must rise with the order.  The blocks' totals are as many rows as there are blocks.
    """
    d = df.withColumns({"_block": block} | {f"_v_{k}": v for k, v in sums.items()})
    keys = [f"_w_{c}" for c in within]
    totals = d.groupBy(F.col("_block").alias("_b"), *(F.col(c).alias(k) for c, k in zip(within, keys, strict=True))).agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", *keys, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    own = Window.partitionBy(*within, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(own) for k in sums}).join(totals, [F.col("_block") == F.col("_b"), *same_keys(within, keys)])
    return d.select(*df.columns, *((F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def same_keys(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    """Conditions of a join by columns of which NULL is a value too."""
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]


def prefix_max(df: DataFrame, block: Column, order: Sequence[str], name: str, value: Column, within: Sequence[str] = ()) -> DataFrame:
    """df with the running maximum of value, over all rows (of equal columns `within`)."""
    d = df.withColumns({"_block": block, "_v": value})
    keys = [f"_w_{c}" for c in within]
    tops = d.groupBy(F.col("_block").alias("_b"), *(F.col(c).alias(k) for c, k in zip(within, keys, strict=True))).agg(F.max("_v").alias("_t"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", *keys, F.max("_t").over(before).alias("_o"))
    own = Window.partitionBy(*within, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_r", F.max("_v").over(own)).join(tops, [F.col("_block") == F.col("_b"), *same_keys(within, keys)])
    return d.select(*df.columns, F.greatest("_r", "_o").alias(name))


def numbered(df: DataFrame, block: Column, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """df with its rows numbered from 0, those of equal columns `within` by themselves."""
    return prefix_sums(df, block, order, {name: F.lit(1).cast("long")}, within).withColumn(name, F.col(name) - 1)


def in_lanes(df: DataFrame, seq: str, by: Sequence[str]) -> DataFrame:
    """df, numbered within `by`, with the numbers of each instrument moved to its own lane; lanes go by the columns `by`, NULL first.

    The table of lanes has a row an instrument.
    """
    keys = [f"_l_{c}" for c in by]
    lanes = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).distinct()
    lanes = lanes.withColumn("_lane", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
    return df.join(lanes, same_keys(by, keys)).withColumn(seq, F.col(seq) + F.col("_lane") * LANE).drop("_lane", *keys)


def with_margin(df: DataFrame, seq: str, back: int, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """df with _block and _own: each block has its own rows, and copies of `back` rows before and `ahead` rows after.

    Windows over `margin_window` see what a window over the whole table would, as far as the margins go;
    `own_rows` then drops the copies.
    """
    if max(back, ahead) > block:
        raise ValueError("a margin may not be longer than a block")
    own = F.floor(F.col(seq) / block)
    place = F.pmod(F.col(seq), F.lit(block))
    homes = F.array_compact(F.array(own, F.when(place >= block - back, own + 1), F.when(place < ahead, own - 1)))
    return df.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == own)


def margin_window(seq: str = "bar_seq"):
    return Window.partitionBy("_block").orderBy(seq)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")
