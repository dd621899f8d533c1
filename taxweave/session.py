"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "taxweave", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings this package is measured with.

    Adaptive execution sizes the shuffle partitions, splits skewed join
    partitions and turns a join into a broadcast join only after it has seen
    that one side is small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of each column expression costs more
        # than planning the query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out rows by a key, whatever the size of the scan and the splits of its files, so that later sums by the
    key are combined before they are shuffled. Spark splits the partitions of hot keys."""
    return df.hint("rebalance", key)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


@lru_cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="run-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path for one written table."""
    return f"{shared_folder(spark)}/taxweave/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind. Otherwise they stay until the driver happens to
    collect its garbage, and those of all steps add up on the executors' disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and go on from the written table.

    Used where several branches read one costly result: it is computed once,
    and a lost executor costs a re-read and not a re-computation.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(settled: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in settled.inputFiles()}:
        remove(settled.sparkSession, folder)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def settling(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """`settle` for tables that nothing needs after this block; they are removed then."""
    paths = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_folder(spark, name))
        with tidy(spark):
            df.write.option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)
