"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.spanloom.scratch.dir"
_written: list[str] = []

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spanloom")
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    `spark.spanloom.scratch.dir` if set, else the one the cluster names in
    `spark.checkpoint.dir`. Where neither is set, a local master gets a folder
    of this machine; any other master is refused, as its executors would not
    see that folder.
    """
    for key in (SCRATCH_KEY, "spark.checkpoint.dir"):
        folder = spark.conf.get(key, None)
        if folder:
            return folder
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set {SCRATCH_KEY} or spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spanloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; `clear_scratch` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a scratch table and read again: computed once, with its lineage cut."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def unsorted_folders(spark: SparkSession, folders: int = 4) -> Iterator[None]:
    """Writes in here do not sort a task's rows by folder first, while the task has at most so many folders."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(folders))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this process. Results that still read one are lost."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
