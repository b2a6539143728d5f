"""Frames written once to the shared folder of spark.checkpoint.dir, so that they are computed once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths written so far, by application, and the open scopes, innermost last.
_made: dict[str, list[str]] = {}
_scopes: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """The session's setting; a local folder only where it is unset and Spark runs in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="spark-scratch-"))
    return base.rstrip("/")


def noted(spark: SparkSession, path: str) -> str:
    """A path that `scope` and `clear` are to delete."""
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return noted(spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    path = path or fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = path_of(spark, path)
        fs.delete(p, True)
    held = _made.get(spark.sparkContext.applicationId, [])
    gone = set(paths)
    held[:] = [x for x in held if x not in gone]


@contextmanager
def scope(spark: SparkSession) -> Iterator[set[str]]:
    """What is written inside is deleted at the end, but for paths added to the set that this gives; they go to the scope around."""
    kept: set[str] = set()
    _scopes.append([])
    try:
        yield kept
    finally:
        own = _scopes.pop()
        delete(spark, [x for x in own if x not in kept])
        if _scopes:
            _scopes[-1].extend(x for x in own if x in kept)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written and not deleted; frames that read it are of no use then."""
    delete(spark, list(_made.get(spark.sparkContext.applicationId, [])))
