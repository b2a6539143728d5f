"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources.scratch import delete, fresh
from tickforge.sources.scratch import written as materialize

#: The white space of every contract in this package: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["SPACE", "SPACES", "WORD", "arrow_batches", "drop_scratch", "fresh", "let", "materialize", "table", "without_ids", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that a Python worker gets at once; a longer row is a batch by itself.
BATCH_BYTES = 2 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds by bytes, as texts may be long.

    It is the one session setting of this package, always of the same value, and only lowers what is set: plans that run
    later can't be changed by another operator.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


#: Identifiers up to this number (a few MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose id is in ids (one column, written already, so that it is cheap to count)."""
    ids = ids.toDF("_gone")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(id_col) == F.col("_gone"), "left_anti")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though body names it often."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and for white space alone."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
