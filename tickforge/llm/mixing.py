"""Mixing sources to target weights (native).

Tokens are summed per source, each source gets a target by its weight, and every document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability,
where rate = target / size of the source.

Defined cases
* null text: size 0, taken 0; null source: a source of its own, last in order.
* Repeated rows: each is counted and emitted; rows with equal id and text share one draw.
* Ties: sources are ordered by code point, so there are none.
* A source without words has target 0 and rate 0.  An empty table gives an empty table.
* Whole texts are counted, in the JVM, whatever their length.
* Extra columns pass through `mix` and `emit`; internal names start with `_mix_`, and a `copy_no` that is there already stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: More sources than this are joined by shuffle (adaptive execution splits hot ones) and not broadcast.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    The share of a source is its weight's share of all sizes.  Sources are filled like vessels:
    in the order of cap * size / weight, a source whose level lies under its cap's is full, and
    the first that isn't sets the level of all that follow.  That is where reshaping the excess
    by weight, again and again, ends.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    d = d.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    d = d.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("full"))
    d = d.withColumn("level", F.max(F.when(~F.col("is_full"), F.col("level"))).over(every))
    target = F.when(F.col("is_full"), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("weight")))
    return d.select("source", "source_size", target.cast("double").alias("target"))


def copies_of(doc_id: Column, text: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more if the hash of seed, id and text lies under the fraction."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    sized = docs.withColumn("_mix_size", size_of(docs[text_col]))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    plan = materialize(source_targets(sizes, weights, cap), "mix-targets").toDF("_mix_source", "_mix_source_size", "_mix_target")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, sized[source_col].eqNullSafe(plan["_mix_source"]), "left").drop("_mix_source")
    rate = F.coalesce(F.try_divide("_mix_target", F.col("_mix_source_size").cast("double")), F.lit(0.0))
    return joined.withColumn("_mix_copies", copies_of(F.col(id_col), F.col(text_col), rate, seed))


def copy_column(columns: Sequence[str], name: str = "copy_no") -> str:
    """The name, or where a column has it already, the name with the next free number."""
    n, out = 1, name
    while out in columns:
        n += 1
        out = f"{name}_{n}"
    return out


def emit(mixed: DataFrame) -> DataFrame:
    """One row a copy, with copy_no (copy_no_2 and so on where the name is taken) from 1; the working columns go."""
    name = copy_column(mixed.columns)
    out = mixed.where(F.col("_mix_copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return out.drop("_mix_size", "_mix_source_size", "_mix_target", "_mix_copies")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS full_size FROM s),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(full_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
      FROM w WINDOW b AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, lev * weight >= full_size AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN full_size ELSE least(full_size, weight * max(CASE WHEN NOT is_full THEN lev END) OVER ()) END AS target FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
             CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

QUERIES = {"op3_mixing": op3_mixing}
SQL = {"op3_mixing": OP3_SQL}
