"""Cutting lineage of iterative plans in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="frameloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few short columns that a broadcast may hold: some tens of MB.
FEW = 200_000


def broadcast_if_few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, which must be materialised and narrow, marked for a broadcast where its counted rows are few; else it is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def through_files(spark: SparkSession, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` finds in a new folder of the shared one that `write` has filled; the folder is gone afterwards."""
    folder = f"{shared_folder(spark)}/files-{uuid4().hex}"
    try:
        write(folder)
        return checkpointed(read(folder))
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
