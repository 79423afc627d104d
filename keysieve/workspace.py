"""Where streams keep their state and long plans their intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """For local sessions that name none, such as tests; gone when Python ends."""
    folder = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without: its executors are on this machine.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind.

    Else they stay until the driver happens to collect its garbage, beside the table they became.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the workspace that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the workspace.

    For results that several branches of a plan read: they are computed once, and a lost
    executor costs a read, not the computation.
    """
    path = workspace(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
