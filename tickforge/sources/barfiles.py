"""A sink of 60-byte minute-bar records, a file a day: tasks write beside the place, and files appear together when all tasks are done.

    bars.write.format("bar_files").option("path", "/shared/bars").mode("append").save()

Rows come with a day in one task and in order of time (`tables.write_bar_files` sees to both), so a task holds a batch and its open file.
A task that fails or is run twice leaves nothing in place: each attempt has a folder of its own, and only files of attempts that Spark commits are moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .binary import BAR
from .splits import opened

SCHEMA = "day string, ticks long, open double, high double, low double, close double, sell_count long, buy_count long, volume long"


@dataclass
class Written(WriterCommitMessage):
    """Days by the folder they were written to."""

    folder: str
    days: list[str]


class BarWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.path}/_unfinished-{self.job}/{uuid.uuid4().hex}"
        fs, base = opened(folder)
        out, day, total, days = None, None, 0, []
        try:
            for b in batches:
                names = b.column("day").to_pylist()
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    if names[lo] != day:
                        if names[lo] in days:
                            raise ValueError(f"rows of {names[lo]} aren't together")
                        if out:
                            out.close()
                        if out is None:
                            fs.create_dir(base, recursive=True)
                        day, total = names[lo], 0
                        days.append(day)
                        out = fs.open_output_stream(f"{base}/{day}.data")
                    r = np.zeros(hi - lo, BAR)
                    for n in BAR.names:
                        if n in b.schema.names:
                            r[n] = b.column(n).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    r["cumulative_volume"] = total + np.cumsum(r["volume"].astype(np.int64))
                    total = int(r["cumulative_volume"][-1])
                    out.write(r.tobytes())
        finally:
            if out:
                out.close()
        return Written(folder, days)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.days:
                fs, base = opened(m.folder)
                _, place = opened(self.path)
                for day in m.days:
                    fs.move(f"{base}/{day}.data", f"{place}/{day}.data")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, base = opened(f"{self.path}/_unfinished-{self.job}")
        if fs.get_file_info(base).type != pafs.FileType.NotFound:
            fs.delete_dir(base)


class BarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> BarWriter:
        return BarWriter(self.options["path"])
