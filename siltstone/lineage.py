"""Cuts of lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder that was set on its context; every executor must see it.

    A session on this machine alone (master ``local``) without one gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder; a lost executor costs nothing then."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no plan reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends; tables that nobody outside the session reads needn't stay."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
