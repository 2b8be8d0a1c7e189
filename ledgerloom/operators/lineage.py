"""Cutting lineage with reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Where it is unset, a temporary one serves a local session, whose driver and executors are one process; a cluster
    has no such folder, and the call fails rather than write where other machines can't read.
    """
    sc, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(df.sparkSession)
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Let the cluster delete shuffles, broadcasts and checkpoints that nothing refers to any more.

    Spark does so when the driver collects its garbage, of which a loop over small tables makes too little.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
