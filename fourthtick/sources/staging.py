"""Where intermediate results are written that are used more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A local session has all its executors on this machine; only there does a
    temporary folder stand in for a missing setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    """One temporary folder per process, for sessions whose executors are this machine."""
    return tempfile.mkdtemp(prefix="fourthtick-")


_STAGING: ContextVar[str | None] = ContextVar("staging", default=None)


def staging_folder(spark: SparkSession) -> str:
    """Where ``stage`` writes: the folder of the innermost ``staging`` block, else the shared one."""
    return _STAGING.get() or shared_folder(spark)


def stage(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write an intermediate result once and go on from the written files.

    Whatever reads the result afterwards starts from these files: it is computed
    once, its lineage ends here, and no executor holds the only copy.
    """
    spark = rows.sparkSession
    path = f"{folder or staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one, deleted at the end of the block.

    Results staged inside the block go there, unless they name another folder: what
    outlives the block is staged to the ``staging_folder`` from before it.
    """
    folder = f"{shared_folder(spark)}/staging-{uuid.uuid4().hex}"
    before = _STAGING.set(folder)
    try:
        yield folder
    finally:
        _STAGING.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
