"""Fixed-width binary files of ticks (57 bytes) and minute bars (60 bytes), read through Spark's binaryFile source.

A file is one task; ingest to Parquet once (`ingest`) and query that.  Trailing bytes that are no whole record are ignored,
or the file is left out with strict=True; an empty file has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions import market

from .events import enrich
from .scratch import path_of, written

#: The record layouts, little-endian.
TICK = np.dtype([("ticks", "<i8"), ("price", "<f8"), ("level_low", "<f8"), ("level_high", "<f8"), ("txn_count", "<u4"), ("txn_count_dup", "<u4"), ("cumulative_txn", "<u4"), ("reserved_1", "<u4"), ("reserved_2", "<u4"), ("reserved_3", "<u4"), ("flag", "u1")])
BAR = np.dtype([("ticks", "<i8"), ("high", "<f8"), ("low", "<f8"), ("open", "<f8"), ("close", "<f8"), ("sell_count", "<u4"), ("buy_count", "<u4"), ("volume", "<u4"), ("cumulative_volume", "<u4"), ("reserved", "<u4")])
ROWS = 50_000


def _schema(kind: np.dtype) -> str:
    types = {"i8": "long", "f8": "double", "u4": "long", "u1": "short"}
    return "source_file string, record_num long, " + ", ".join(f"{n} {types[kind[n].str[1:]]}" for n in kind.names)


def _name():
    return F.element_at(F.split("path", "/"), -1).alias("source_file")


def _read(spark: SparkSession, paths: str | Sequence[str], kind: np.dtype, strict: bool, glob: str) -> DataFrame:
    paths = sorted({paths} if isinstance(paths, str) else set(paths))
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    if strict:
        files = files.where((F.col("length") > 0) & (F.col("length") % kind.itemsize == 0))
    return _decoded(files.select(_name(), "content"), kind)


def _decoded(files: DataFrame, kind: np.dtype, also: Sequence[str] = ()) -> DataFrame:
    """The records of (source_file, content), with columns `also` of their file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content, *more in zip(b["source_file"], b["content"], *(b[c] for c in also), strict=True):
                whole = len(content) // kind.itemsize
                for at in range(0, whole, ROWS):
                    r = np.frombuffer(content, kind, min(ROWS, whole - at), at * kind.itemsize)
                    out = {n: r[n].astype("int64" if r[n].dtype.kind == "u" and r[n].dtype.itemsize > 1 else "int16" if r[n].dtype.kind == "u" else r[n].dtype) for n in kind.names}
                    yield pd.DataFrame({"source_file": name, "record_num": np.arange(at, at + len(r)), **out, **dict(zip(also, more, strict=True))})

    schema = _schema(kind) + "".join(f", {c} string" for c in also)
    return files.mapInPandas(decode, schema).withColumn("ts", market.from_dotnet_ticks(F.col("ticks")))


def read_ticks(spark: SparkSession, paths: str | Sequence[str], strict: bool = False, unknown_as_sell: bool = False, glob: str = "*") -> DataFrame:
    """Ticks with direction, signed volume and session; paths may be files and folders."""
    t = enrich(_read(spark, paths, TICK, strict, glob))
    if unknown_as_sell:
        t = t.withColumn("direction", F.when(F.col("direction") == 0, -1).otherwise(F.col("direction"))).withColumn("volume_delta", F.col("direction") * F.col("txn_count"))
    return t


def read_minute_bars(spark: SparkSession, paths: str | Sequence[str], strict: bool = False, glob: str = "*") -> DataFrame:
    """Bars with volume_delta and its running sum over each file."""
    b = _read(spark, paths, BAR, strict, glob).withColumn("volume_delta", F.col("buy_count") - F.col("sell_count"))
    w = Window.partitionBy("source_file").orderBy("record_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumn("cumulative_volume_delta", F.sum("volume_delta").over(w))


def files_of(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.data") -> DataFrame:
    """(path, length, modified) of the files under paths, each once."""
    paths = sorted({paths} if isinstance(paths, str) else set(paths))
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "length", F.col("modificationTime").alias("modified")).distinct()


def required(spark: SparkSession, paths: str | Sequence[str], kind: np.dtype = TICK, glob: str = "*.data") -> None:
    """Raise if there is no file, or no whole record in any."""
    if files_of(spark, paths, glob).where(F.col("length") >= kind.itemsize).isEmpty():
        raise ValueError(f"no records in {glob} of {paths}")


def viewer_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks as the viewer decodes them: times cut to whole seconds."""
    return ticks.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) * 1_000_000).cast("timestamp_ntz"))


def ingest(spark: SparkSession, paths: str | Sequence[str], out: str, glob: str = "*.data") -> DataFrame:
    """Decode once to Parquet, partitioned by session; files that the table has already (by path, size and time) are left out.

    A file that has changed is decoded anew and its former rows are left out by the log's newest entry of its path.
    """
    files = files_of(spark, paths, glob)
    fs, p = path_of(spark, f"{out}/log")
    if fs.exists(p):
        files = files.join(spark.read.parquet(f"{out}/log").select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    files = written(files.withColumn("batch", F.expr("uuid()")), "ingest-files")
    if not files.isEmpty():
        content = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(sorted({paths} if isinstance(paths, str) else set(paths)))
        new = content.join(files.select("path", "batch"), "path")
        enrich(_decoded(new.select(_name(), "content", "batch"), TICK, ["batch"])).write.mode("append").partitionBy("session_date").parquet(f"{out}/ticks")
        files.write.mode("append").parquet(f"{out}/log")
    newest = spark.read.parquet(f"{out}/log").groupBy("path").agg(F.max_by("batch", "modified").alias("batch")).select("batch")
    return spark.read.parquet(f"{out}/ticks").join(newest, "batch", "left_semi").drop("batch")


def encode(kind: np.dtype, rows: pd.DataFrame) -> bytes:
    r = np.zeros(len(rows), kind)
    for n in kind.names:
        if n in rows:
            r[n] = rows[n].to_numpy()
    return r.tobytes()
