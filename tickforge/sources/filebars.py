"""Bars of a folder of tick files that are kept as partial bars of each file: a file that has changed or come costs its own decoding and no other.

The store has a folder for each state of a file (by path, length and time) and width; files that are gone, and former states of files, are left out when bars are put
together, and `sweep` deletes them.  Bars in which files overlap in time, so that runs can't be told from partial bars, are made from the ticks of those files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import bars, partial

from . import splits
from .binary import TICK
from .scratch import delete, path_of, written


def _files(paths: str | Sequence[str], width: str, suffix: str) -> dict[str, str]:
    """Of each file with records, by its key in the store, its path."""
    found = {f for p in ([paths] if isinstance(paths, str) else paths) for f in splits.files_under(p, suffix)}
    return {hashlib.sha256(f"{width} {path} {size} {time}".encode()).hexdigest()[:24]: path for path, size, time in sorted(found) if size >= TICK.itemsize}


def _kept(spark: SparkSession, store: str) -> set[str]:
    fs, p = path_of(spark, store)
    return {x.getPath().getName().removeprefix("file=") for x in fs.listStatus(p) if x.isDirectory()} if fs.exists(p) else set()


def missing(spark: SparkSession, paths: str | Sequence[str], width: str, store: str, suffix: str = ".data") -> list[str]:
    """The files that file_bars would decode now."""
    kept = _kept(spark, store)
    return [path for key, path in _files(paths, width, suffix).items() if key not in kept]


def file_bars(spark: SparkSession, paths: str | Sequence[str], width: str, store: str, suffix: str = ".data", span: int = splits.RANGE) -> DataFrame:
    """The bars of all files; those whose partial bars the store hasn't got are decoded, in ranges, and added to it in one job."""
    files, kept = _files(paths, width, suffix), _kept(spark, store)
    new = {path: key for key, path in files.items() if key not in kept}
    if new:
        keys = spark.createDataFrame(list(new.items()), "_p string, file string")
        t = splits.read_ticks(spark, sorted(new), span=span, suffix=suffix, full_path=True)
        t = t.join(F.broadcast(keys), F.col("source_path") == F.col("_p"))
        part = written(partial.partial_bars(t, width, by=("file",)), "file-bars")
        part.write.mode("append").partitionBy("file").parquet(store)
    if not files:
        raise ValueError(f"no records in files of {paths}")
    parts = spark.read.parquet(store).where(F.col("file").isin(list(files)))
    b = written(partial.merged(parts, width), "merged-bars")
    crossed = b.where("overlaps").select("bar_time")
    if crossed.isEmpty():
        return b.drop("overlaps")
    # The files that have a part in such a bar, and of them the ticks of such bars.
    at = parts.join(crossed, "bar_time", "left_semi").select("file").distinct().collect()
    t = splits.read_ticks(spark, sorted(files[r["file"]] for r in at), span=span, suffix=suffix, full_path=True)
    t = t.withColumn("bar_time", bars.bar_time(width)).join(crossed, "bar_time", "left_semi").drop("bar_time")
    return b.where("NOT overlaps").drop("overlaps").unionByName(bars.time_bars(t, width))


def sweep(spark: SparkSession, paths: str | Sequence[str], width: str, store: str, suffix: str = ".data") -> int:
    """Delete what the store keeps of files that are no more or have changed; their number."""
    gone = _kept(spark, store) - set(_files(paths, width, suffix)) - {"_temporary"}
    delete(spark, [f"{store}/file={k}" for k in gone])
    return len(gone)
