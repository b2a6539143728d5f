"""Derived tables kept by what they come from: decoded once, and read by every later query of the same files.

The key of a table is its name and the path, length and time of every input file, so a changed input is decoded anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .scratch import folder, path_of


def fingerprint(spark: SparkSession, path: str) -> str:
    """The files under a path (or the file), with their lengths and times."""
    fs, p = path_of(spark, path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:16]


def cached(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a table in the shared folder, written unless it is there.  It appears whole or not at all."""
    path = f"{folder(spark)}/cache/{name}-{fingerprint(spark, source)}"
    fs, p = path_of(spark, path)
    if not fs.exists(p):
        part = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(part)
        if not fs.rename(path_of(spark, part)[1], p):
            fs.delete(path_of(spark, part)[1], True)
    return spark.read.parquet(path)
