"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a session on one machine (master ``local[...]``) gets a temporary
    folder; on a cluster that is an error, for executors would not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_CONF, None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError(
                f"no folder for intermediate tables: set {_CONF}, give make_session(scratch=...), "
                "or call SparkContext.setCheckpointDir, with a folder that all executors share"
            )
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/gapline/{name}-{uuid.uuid4().hex}"


def temporary_path(spark: SparkSession, name: str) -> str:
    """A fresh path that is deleted with the tables made within ``cleared``."""
    path = scratch_path(spark, name)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: losing an executor cannot change or recompute it. The table stays
    until the folder is cleared, as lazy results need it, unless it is made within ``cleared``.
    """
    path = temporary_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written within, once nothing reads them any more."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            _at(spark, path)[0].delete(_at(spark, path)[1], True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever file system it names."""
    system, where = _at(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in the folder at ``path``; none if there is no such folder."""
    system, where = _at(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(where)] if system.exists(where) else []


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
