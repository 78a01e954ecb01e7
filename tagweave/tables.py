"""Intermediate tables in the shared folder of the cluster, so that lost executors take no results with them."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: a side of a join is broadcast up to this many rows
FEW = 500_000
_own: dict[str, str] = {}
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir; one of our own on a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/tagweave/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the table to the shared folder and reads it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that it is never broadcast: Spark judges it by its file, and rows take many times that in memory, exploded ones more."""
    return df.hint("merge")


def release(spark: SparkSession, kept: int = 0) -> None:
    """Deletes what this process has written after the first ``kept`` tables; frames that read it are void."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > kept:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end; for one thread at a time."""
    n = len(_written)
    try:
        yield
    finally:
        release(spark, n)
