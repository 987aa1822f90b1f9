"""Lineage cuts: intermediate results as tables in the folder that spark.checkpoint.dir names, and who owns them.

A scope owns what is cut while it is active in its thread: one folder below the shared one, deleted as a whole when the
scope closes. Scopes of other threads, and scopes inside this one, own folders of their own, so none deletes what
another still reads. Without a scope a cut stays until somebody deletes it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes it to have, so that tasks which open files themselves open the same ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_system(path: str):
    """(file system, path in it) of a qualified path, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return qualified(spark, named).rstrip("/")


class ScopeClosed(RuntimeError):
    def __init__(self):
        super().__init__("this scope is closed; its tables are gone")


class Scope:
    """A folder of cuts with one owner. active() makes it the owner of what this thread cuts meanwhile; close() deletes
    the folder, after which no frame that reads from it works and nothing more can be cut into it."""

    def __init__(self, spark: SparkSession, label: str = "scope"):
        self.folder, self.closed = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", False
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)  # held, to be deleted even when Spark has stopped
        self._files = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    @contextmanager
    def active(self) -> Iterator[Scope]:
        if self.closed:
            raise ScopeClosed
        before = _ACTIVE.set(self)
        try:
            yield self
        finally:
            _ACTIVE.reset(before)

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self._files.delete(self._path, True)


_ACTIVE: ContextVar[Scope | None] = ContextVar("active_scope", default=None)


@contextmanager
def scope(spark: SparkSession, label: str = "scope") -> Iterator[Scope]:
    """A scope that is active inside the block and closed at its end. Results must have been written by then."""
    own = Scope(spark, label)
    try:
        with own.active():
            yield own
    finally:
        own.close()


def new_folder(spark: SparkSession, label: str) -> str:
    owner = _ACTIVE.get()
    if owner is not None and owner.closed:
        raise ScopeClosed
    return f"{owner.folder if owner else shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
