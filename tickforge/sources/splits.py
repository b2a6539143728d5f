"""A batch source of 57-byte tick files that splits and skips: a partition is a range of whole records, and a span of time leaves ranges out.

    read_ticks(spark, ["/data/a.data", "/data/more"], since=datetime(2024, 1, 2), until=datetime(2024, 1, 3), ordered=True)

A range is read in batches of ROWS records, so a file of any size is many tasks of bounded memory.  What a range holds is known from
a sparse index: the first and last time of each range as the option `index` gives it (a table that `write_index` makes with one pass in
Spark, right for files in any order), or with `ordered` set, from the records on the ranges' borders (two reads of 8 bytes a
range, for files whose times don't fall).  Without either all ranges are read.  `read_ticks` filters what is read again, so skipping
never changes a result.

The span is an option of the load and not a filter pushed down to the source: a Python source of Spark 4.1 keeps what was pushed to it, and a
later query of the same DataFrame without that filter would lose rows.

Defined cases
* Bytes behind the last whole record are ignored; files with none have no rows; a folder without files is no error here.
* Files are opened through pyarrow's file systems: local paths, and addresses with a scheme, by the driver and by tasks alike.
* A file that was written anew after its index has another size or time and is read whole.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import TICK
from .events import enrich
from .scratch import written

SCHEMA = "source_file string, record_num long, ticks long, price double, level_low double, level_high double, txn_count long, txn_count_dup long, cumulative_txn long, reserved_1 long, reserved_2 long, reserved_3 long, flag short, ts timestamp_ntz, source_path string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Records of a range and of a batch, unless an option says otherwise.
RANGE, ROWS = 2_000_000, 100_000
#: Ticks of 100 ns from the year 1 to 1970.
EPOCH = 621_355_968_000_000_000
FOREVER = (-(1 << 63), (1 << 63) - 1)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_under(path: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path as it was given or below it, bytes, time in ns), sorted."""
    fs, p = opened(path)
    head = path[: len(path) - len(p)] if path.endswith(p) else ""
    info = fs.get_file_info(p)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(p, recursive=True))
    return sorted((head + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File and (f is info or f.path.endswith(suffix)))


def records(path: str, begin: int, count: int) -> np.ndarray:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        return np.frombuffer(f.read_at(count * TICK.itemsize, begin * TICK.itemsize), TICK)


def micros(at: datetime.datetime) -> int:
    if at.tzinfo:
        at = at.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return (at - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


class Range(InputPartition):
    """`count` records of a file from `begin` on."""

    def __init__(self, path: str, begin: int, count: int):
        self.path, self.begin, self.count = path, begin, count


class TickReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.suffix = options.get("suffix", ".data")
        self.range = int(options.get("range", RANGE))
        self.ordered = options.get("ordered", "false").lower() == "true"
        self.index = options.get("index")
        #: The lowest and highest of ticks that are asked for, both included.
        self.low, self.high = int(options.get("low", FOREVER[0])), int(options.get("high", FOREVER[1]))

    def bounds(self, path: str, size: int, time: int, ranges: list[Range]) -> list[tuple[int, int]]:
        """The lowest and highest ticks of each range, as far as they are known."""
        if (self.low, self.high) == FOREVER:
            return [FOREVER] * len(ranges)
        if self.index:
            known = self._indexed().get((path, size, time), {})
            return [known.get((r.begin, r.count), FOREVER) for r in ranges]
        if self.ordered:
            fs, p = opened(path)
            with fs.open_input_file(p) as f:
                at = lambda k: int(np.frombuffer(f.read_at(8, k * TICK.itemsize), "<i8")[0])
                return [(at(r.begin), at(r.begin + r.count - 1)) for r in ranges]
        return [FOREVER] * len(ranges)

    def _indexed(self) -> dict:
        from pyarrow import parquet

        if not hasattr(self, "_index"):
            fs, p = opened(self.index)
            parts = [f.path for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.path.endswith(".parquet")]
            self._index: dict = {}
            for part in parts:
                for row in parquet.read_table(part, filesystem=fs).to_pylist():
                    self._index.setdefault((row["path"], row["length"], row["modified"]), {})[row["begin"], row["count"]] = (row["low"], row["high"])
        return self._index

    def ranges(self) -> list[Range]:
        """All ranges, whether they are to be read or not, with what is known of them."""
        out = []
        for path, size, time in sorted({f for p in self.paths for f in files_under(p, self.suffix)}):
            n = size // TICK.itemsize
            own = [Range(path, a, min(self.range, n - a)) for a in range(0, n, self.range)]
            out += zip(own, self.bounds(path, size, time, own), strict=True)
        return out

    def wanted(self, bounds: tuple[int, int]) -> bool:
        return bounds[1] >= self.low and bounds[0] <= self.high

    def partitions(self) -> list[Range]:
        return [r for r, known in self.ranges() if self.wanted(known)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        name = part.path.rsplit("/", 1)[-1]
        for at in range(part.begin, part.begin + part.count, ROWS):
            r = records(part.path, at, min(ROWS, part.begin + part.count - at))
            columns = {"source_file": pa.array([name]).take(pa.array(np.zeros(len(r), np.int64))), "record_num": pa.array(np.arange(at, at + len(r)))}
            for n in TICK.names:
                columns[n] = pa.array(r[n].astype("int16" if n == "flag" else "int64" if r[n].dtype.kind in "ui" else "float64"))
            columns["source_path"] = pa.array([part.path]).take(pa.array(np.zeros(len(r), np.int64)))
            columns["ts"] = pa.array((r["ticks"] - EPOCH) // 10).cast(pa.timestamp("us"))
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in _NAMES})


class TickFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TickReader:
        return TickReader(self.options)


def write_index(spark: SparkSession, paths: str | Sequence[str], out: str, span: int = RANGE, suffix: str = ".data") -> DataFrame:
    """The sparse index of files, a row a range: path, length, modified, begin, count, low and high; ranges are read once, in tasks of their own."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [f for p in paths for f in files_under(p, suffix)]
    d = spark.createDataFrame(files, "path string, length long, modified long").withColumn("n", F.floor(F.col("length") / TICK.itemsize))
    d = d.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(span))).alias("begin")).withColumn("count", F.least(F.lit(span), F.col("n") - F.col("begin")))
    d = d.select("path", "length", "modified", F.col("begin").cast("long").alias("begin"), F.col("count").cast("long").alias("count"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = [], []
            for path, begin, count in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                parts = [records(path, a, min(ROWS, begin + count - a))["ticks"] for a in range(begin, begin + count, ROWS)]
                low.append(min(int(x.min()) for x in parts))
                high.append(max(int(x.max()) for x in parts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=[*b.schema.names, "low", "high"])

    return written(d.repartition(max(1, min(d.count(), 10_000)), "path", "begin").mapInArrow(measured, "path string, length long, modified long, begin long, count long, low long, high long"), "tick-index", out)


def ticks_at(at: datetime.datetime) -> int:
    """The number of 100 ns from the year 1 to a time."""
    return micros(at) * 10 + EPOCH


def options_of(paths: str | Sequence[str], since: datetime.datetime | None, until: datetime.datetime | None, span: int, ordered: bool, index: str | None, suffix: str) -> dict[str, str]:
    bounds = {"low": ticks_at(since)} if since else {}
    bounds |= {"high": ticks_at(until) - 1} if until else {}
    more = {"index": index} if index else {}
    return {k: str(v) for k, v in ({"paths": paths if isinstance(paths, str) else ",".join(paths), "range": span, "ordered": str(ordered).lower(), "suffix": suffix} | bounds | more).items()}


def read_ticks(spark: SparkSession, paths: str | Sequence[str], since: datetime.datetime | None = None, until: datetime.datetime | None = None, span: int = RANGE, ordered: bool = False, index: str | None = None, suffix: str = ".data", full_path: bool = False) -> DataFrame:
    """What binary.read_ticks gives of times from since to before until, from ranges of files; and source_path if full_path."""
    spark.dataSource.register(TickFiles)
    d = spark.read.format("tick_files").options(**options_of(paths, since, until, span, ordered, index, suffix)).load()
    if since:
        d = d.where(F.col("ticks") >= ticks_at(since))
    if until:
        d = d.where(F.col("ticks") < ticks_at(until))
    return enrich(d if full_path else d.drop("source_path"))


def skipped(paths: str | Sequence[str], since: datetime.datetime | None = None, until: datetime.datetime | None = None, span: int = RANGE, ordered: bool = False, index: str | None = None, suffix: str = ".data") -> tuple[int, int]:
    """(ranges that a read of this span of time leaves out, all ranges)."""
    r = TickReader(options_of(paths, since, until, span, ordered, index, suffix))
    every = r.ranges()
    return len(every) - sum(r.wanted(x) for _, x in every), len(every)
