"""A streaming source of binary tick files that grow: the offset is how many bytes of each file have been read.

    spark.dataSource.register(TickFolder)
    spark.readStream.format("tick_folder").option("path", "/shared/ticks").load()

The folder must be one that the driver and all executors can open by that path.  Only whole records
count, so a record that is being written is read when it is complete; a file that has shrunk isn't read again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tickforge.sources.binary import TICK

SCHEMA = "source_file string, record_num long, ts timestamp, price double, level_low double, level_high double, txn_count long, direction int, volume_delta long"
#: Bytes of a file in one partition.
SPLIT = TICK.itemsize * 500_000
_TYPES = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class TickReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = {f: os.path.getsize(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(self.suffix)}
        return {f: n - n % TICK.itemsize for f, n in sizes.items() if n >= TICK.itemsize}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, a, min(a + SPLIT, n)) for f, n in end.items() for a in range(start.get(f, 0), n, SPLIT)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(os.path.join(self.folder, part.file), "rb") as f:
            f.seek(part.begin)
            r = np.frombuffer(f.read(part.end - part.begin), TICK)
        side = np.where(np.abs(r["price"] - r["level_high"]) < 1e-9, 1, np.where(np.abs(r["price"] - r["level_low"]) < 1e-9, -1, 0))
        number = part.begin // TICK.itemsize + np.arange(len(r))
        columns = ([part.file] * len(r), number, r["ticks"] // 10 - 62_135_596_800_000_000, r["price"], r["level_low"], r["level_high"], r["txn_count"].astype(np.int64), side.astype(np.int32), side * r["txn_count"].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    def commit(self, end: dict) -> None:
        pass


class TickFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TickReader:
        return TickReader(self.options["path"], self.options.get("suffix", ".data"))
