"""As-of joins without a common key: per block of some minutes, with what the blocks before or after have last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK_SECONDS, same_keys, time_block


def _one_way(keys: Sequence[str], forward: bool) -> Column:
    """The nearest right row before (or after) each left row of the union, within its instrument and block."""
    if forward:
        w = Window.partitionBy(*keys, "_block").orderBy(F.col("_t").desc(), F.col("_left"), F.col("_tie").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        w = Window.partitionBy(*keys, "_block").orderBy("_t", "_left", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("_r", ignorenulls=True).over(w)


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, how: str = "backward", tie: str | None = None, block_seconds: int = BLOCK_SECONDS, by: Sequence[str] = (), block: str | None = None) -> DataFrame:
    """left with `match`, the struct of the right row as of left_time.

    how is `backward` (the last row at or before), `forward` (the first at or after) or `nearest` (of both the
    closer; of equally close ones the later).  Of right rows at one time, backward takes the last
    by `tie` and forward the first.  Rows match those of equal columns `by` alone, NULL being equal to NULL.
    If both sides have the number of their block, of block_seconds, in a column, it is named by `block`; tables that are bucketed
    by it alike are then joined without an exchange of their rows.
    """
    keys, ends_keys = [f"_k_{c}" for c in by], [f"_e_{c}" for c in by]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    number = lambda time: F.col(block) if block else time_block(time, block_seconds)
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    r = right.select(*named, F.col(right_time).alias("_t"), number(right_time).alias("_block"), F.lit(0).alias("_left"), order.alias("_tie"), F.struct(*right.columns).alias("_r"))
    kind = r.schema["_r"].dataType
    ll = left.select(*named, F.col(left_time).alias("_t"), number(left_time).alias("_block"), F.lit(1).alias("_left"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(kind).alias("_r"), F.struct(*left.columns).alias("_l"))
    u = r.withColumn("_l", F.lit(None).cast(ll.schema["_l"].dataType)).unionByName(ll)
    place = F.when(F.col("_left") == 0, F.struct("_t", "_tie"))
    ends = u.groupBy(F.col("_block").alias("_b"), *(F.col(k).alias(e) for k, e in zip(keys, ends_keys, strict=True))).agg(F.max_by("_r", place).alias("_last"), F.min_by("_r", place).alias("_first"))
    blocks = Window.partitionBy(*ends_keys) if by else Window
    ends = ends.select(
        "_b",
        *ends_keys,
        F.last("_last", ignorenulls=True).over(blocks.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        # Backwards, as a frame that grows at its end is kept up to date and one that shrinks is made anew for each row.
        F.last("_first", ignorenulls=True).over(blocks.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    d = u.withColumns({"_p": _one_way(keys, False), "_n": _one_way(keys, True)}).where("_left = 1").join(ends, [F.col("_block") == F.col("_b"), *same_keys(keys, ends_keys)])
    before, after = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    gap = lambda x: F.abs(F.unix_micros(x[right_time].cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    match = {"backward": before, "forward": after}.get(how)
    if match is None:
        match = F.when(before.isNull(), after).when(after.isNull(), before).when(gap(before) < gap(after), before).otherwise(after)
    return d.select("_l.*", match.alias("match"))
