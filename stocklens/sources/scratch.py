"""Intermediate results on the cluster's shared folder.

Work that is read more than once is written as Parquet below
``spark.checkpoint.dir``. That cuts its lineage, survives lost executors and
keeps column pruning for the readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the setting or ``setCheckpointDir``."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError(f"set {SETTING} to a folder that all executors reach")
    return folder.rstrip("/")


def run_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/stocklens/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """The frame written out and read back; the shuffle files of what it is made from are given up."""
    spark = df.sparkSession
    path = run_path(spark, label)
    df.write.parquet(path)
    shuffles_released(spark)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder below the shared one that its owner no longer reads."""
    if "/stocklens/" not in path:
        raise ValueError(f"not a folder of this library: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffles_released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which is rare on a large
    heap; a job of many written steps would keep the shuffles of all of them.
    """
    spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialized`` whose results are deleted at the end of the block.

    What leaves the block must have been written by then. The shuffle files of
    a step are given up once it is written.
    """
    paths = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        paths.append(run_path(spark, label))
        df.write.parquet(paths[-1])
        shuffles_released(spark)
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield kept
    finally:
        for path in paths:
            removed(spark, path)
