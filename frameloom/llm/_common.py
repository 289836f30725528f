"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameloom.lineage import FEW, broadcast_if_few, checkpointed, shared_folder as ensure_checkpoint_dir
from frameloom.workers import ship

__all__ = ["FEW", "broadcast_if_few", "checkpointed", "ensure_checkpoint_dir"]


#: Bytes of texts that go to a Python worker at a time, whatever their length: what bounds its memory, and Spark's beside it.
BATCH_BYTES = 8 << 20


def python_ready(spark: SparkSession) -> None:
    """Workers find this package, and batches for them are small; a session that wants smaller ones yet keeps its setting."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def own_checkpoints(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed within goes at the end: only for work whose result is written elsewhere by then."""
    sc, shared = spark.sparkContext, ensure_checkpoint_dir(spark)
    sc.setCheckpointDir(f"{shared}/stage")
    try:
        yield
    finally:
        own = sc.getCheckpointDir()
        sc.setCheckpointDir(shared)
        remove(spark, own)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any store that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
