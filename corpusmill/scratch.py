"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusmill-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a temporary folder is made where that is unset, one for each process. The setting
    itself can't be changed once a session runs.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_left: dict[str, SparkSession] = {}
_owned: ContextVar[set[str] | None] = ContextVar("owned", default=None)  # what the innermost block of this thread made


def _sweep() -> None:
    for path, spark in list(_left.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and the folder's owner cleans up
            return


atexit.register(_sweep)


class Table:
    """A DataFrame written once as Parquet in the shared folder and read back from there.

    It cuts the lineage and, unlike ``DataFrame.checkpoint``, computes the input once and keeps file statistics for
    later joins. A lost executor costs only the tasks it was running.
    """

    def __init__(self, df: DataFrame, parts: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/corpusmill-{uuid.uuid4().hex}"
        df.write.partitionBy(*parts).parquet(self.path) if parts else df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _left[self.path] = self.spark
        if (owned := _owned.get()) is not None:
            owned.add(self.path)

    def drop(self) -> None:
        _left.pop(self.path, None)
        remove(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of a written table; the files go when the process ends."""
    return Table(df).df


@contextmanager
def dropped_after(spark: SparkSession):
    """Drops the tables that this thread writes inside, but for those whose paths are added to the set that it gives.

    Kept tables belong to the block around this one, if there is one. Tables of other threads and sessions stay.
    """
    mine: set[str] = set()
    keep: set[str] = set()
    before = _owned.set(mine)
    try:
        yield keep
    finally:
        _owned.reset(before)
        if (outer := _owned.get()) is not None:
            outer |= mine & keep
        for path in mine - keep:
            if _left.pop(path, None):
                remove(spark, path)
