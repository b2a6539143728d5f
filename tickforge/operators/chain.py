"""The greedy chain: of candidates in order, take the first that is free, skip to where it ends, and so on.

Only which candidates are taken is sequential.  Blocks of the sequence are handled in parallel: each finds, for every candidate, the place
behind the block at which a chain through it comes out.  Chains that enter a block soon run together, so runs of candidates share
a way out, and there are no more runs than places that a candidate reaches beyond its block's end.  Each run points to the run that its way out leads to.
Which runs the chain goes through is found by pointer doubling: in round k the runs known so far are joined with pointers over 2^k runs, and these with
themselves, so the rounds are the logarithm of the number of blocks.  Then each block marks its part of the chain from where it is entered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.sources.scratch import delete, fresh, written

BLOCK = 200_000
NEVER = 1 << 62


def _runs(slim: DataFrame) -> DataFrame:
    """(b, hi, out): the runs of each block by their last candidate, with their way out (NEVER: none)."""

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, f = pdf["s"].to_numpy(), pdf["f"].to_numpy()
        out, nxt = f.copy(), np.searchsorted(s, f)
        for i in range(len(s) - 1, -1, -1):
            if nxt[i] < len(s):
                out[i] = out[nxt[i]]
        last = np.append(out[1:] != out[:-1], True)
        return pd.DataFrame({"b": pdf["b"].to_numpy()[last], "hi": s[last], "out": out[last]})

    return slim.groupBy("b").applyInPandas(exits, "b long, hi long, out long")


def _pointers(runs: DataFrame, block: int) -> DataFrame:
    """(hi, out, next): next is the run that a way out leads to, the first that ends there or behind; NULL behind the last."""
    asked = runs.where(F.col("out") < NEVER).select("hi", "out", F.floor(F.col("out") / block).alias("ob"))
    ends = runs.groupBy("b").agg(F.sort_array(F.collect_list("hi")).alias("ends"))
    # A block has a sorted list of its runs' ends; the next block that has any is told by the table of blocks.
    every = ends.select("b", F.element_at("ends", 1).alias("first")).unionByName(asked.select(F.col("ob").alias("b"), F.lit(None).cast("long").alias("first")).distinct())
    every = every.groupBy("b").agg(F.max("first").alias("first"))
    later = every.select(F.col("b").alias("lb"), F.min("first").over(Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    inside = asked.join(ends, F.col("ob") == F.col("b"), "left").withColumn("inside", F.array_min(F.filter("ends", lambda x: x >= F.col("out"))))
    return inside.join(later, F.col("ob") == F.col("lb")).select("hi", "out", F.coalesce("inside", "later").alias("next")).where("next IS NOT NULL")


def visited(pointers: DataFrame, start: int) -> DataFrame:
    """(node): the runs that the chain of pointers (hi, next) from start goes through, by pointer doubling."""
    spark = pointers.sparkSession
    seen = spark.createDataFrame([(start,)], "node long")
    jump, old, count = pointers.select("hi", "next"), [], 1
    while True:
        # Those seen are the first 2^k of the chain; one jump of 2^k gives as many again.
        path = fresh(spark, "chain-seen")
        seen = written(seen.unionByName(seen.join(jump, F.col("node") == F.col("hi")).select(F.col("next").alias("node"))), "chain-seen", path)
        now = seen.count()
        # At the chain's end jumps lead nowhere, and nothing more is seen.
        if now < 2 * count:
            delete(spark, old)
            return seen
        count = now
        onward = jump.select(F.col("hi").alias("to"), F.col("next").alias("far"))
        far = fresh(spark, "chain-jump")
        jump = written(jump.join(onward, F.col("next") == F.col("to")).select("hi", F.col("far").alias("next")), "chain-jump", far)
        delete(spark, old)
        old = [path, far]


def greedy_chain(candidates: DataFrame, seq: str, next_free: str, block: int = BLOCK, lane: int | None = None) -> DataFrame:
    """The candidates that the chain takes.

    candidates has a unique integer seq and next_free > seq, the first place at which another may
    start; a null next_free ends the chain.  The chain starts at the smallest seq.  With a lane, each lane of so many
    numbers has a chain of its own: where one ends, or would leave its lane, the next begins, so all are found as one.
    """
    spark = candidates.sparkSession
    candidates = written(candidates, "chain-candidates")
    free = F.coalesce(F.col(next_free).cast("long"), F.lit(NEVER))
    if lane:
        free = F.least(free, (F.floor(F.col(seq) / lane) + 1) * lane)
    slim = candidates.select(F.col(seq).cast("long").alias("s"), free.alias("f"), F.floor(F.col(seq) / block).alias("b"))
    size = slim.agg(F.min("b").alias("low"), F.max("b").alias("high")).first()
    entries = spark.createDataFrame([(size["low"], -NEVER)] if size["low"] is not None else [], "eb long, e long")
    if size["low"] != size["high"]:
        runs = written(_runs(slim), "chain-runs")
        pointers = written(_pointers(runs, block), "chain-pointers")
        start = runs.agg(F.min("hi")).first()[0]
        # The run that the chain goes to is entered at the way out that leads there.
        ways = pointers.join(visited(pointers, start), F.col("hi") == F.col("node"), "left_semi")
        entries = entries.unionByName(ways.select(F.floor(F.col("next") / block).alias("eb"), F.col("out").alias("e")))

    def taken(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(entry):
            rows = rows.sort_values("s")
            s = rows["s"].to_numpy()
            nxt, at = np.searchsorted(s, rows["f"].to_numpy()), int(np.searchsorted(s, entry["e"].iloc[0]))
            while at < len(s):
                out.append(s[at])
                at = int(nxt[at])
        return pd.DataFrame({"t": np.array(out, np.int64)})

    chosen = slim.groupBy("b").cogroup(entries.groupBy("eb")).applyInPandas(taken, "t long")
    return written(candidates.join(chosen, F.col(seq) == F.col("t"), "left_semi"), "chain")
