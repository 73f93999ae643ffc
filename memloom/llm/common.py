"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, opened by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A local master may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "memloom-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives the loss of any executor.

    The write's shuffle files go as soon as it is done, by Spark's own setting for that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def light(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """df, which cut() returned, marked to be sent to every task of a join if it has most rows at most; else a join deals out both sides."""
    return F.broadcast(df) if df.count() <= most else df


def discard(*frames: DataFrame) -> None:
    """Delete the folders behind frames that cut() returned; nothing may read them any more."""
    for df in frames:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
