"""Frames: one row is one time step of one sample.

A sample is identified by KEY; pos is its physical order, step_index the step a user sees. state is an array of one cell type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("task", "shard_id", "sample_id")
ORDER = "pos"
#: Cell types by kind.
KINDS = {"int": "bigint", "float": "double", "bool": "boolean"}


def schema(kind: str) -> str:
    return f"task string, shard_id int, sample_id bigint, pos bigint, step_index bigint, state array<{KINDS[kind]}>, label string"


def kind_of(frames: DataFrame) -> str:
    cell = frames.schema["state"].dataType.elementType.typeName()
    return {"double": "float", "float": "float", "boolean": "bool"}.get(cell, "int")


def sample_window(order: str = ORDER):
    return Window.partitionBy(*KEY).orderBy(order)


def as_frames(df: DataFrame, sample: str | Column, order: list[str | Column], state: Column, task: str = "table", label: Column | None = None) -> DataFrame:
    """Rows of any table as frames: sample names the sample, order its total order, state its cells."""
    key = F.col(sample) if isinstance(sample, str) else sample
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    pos = F.row_number().over(Window.partitionBy(key).orderBy(*columns)) - F.lit(1).cast("bigint")
    named = df.select(F.lit(task).alias("task"), F.lit(0).alias("shard_id"), key.cast("bigint").alias("sample_id"), pos.cast("bigint").alias("pos"), state.alias("state"), (label if label is not None else F.lit(None).cast("string")).alias("label"))
    return named.select("task", "shard_id", "sample_id", "pos", F.col("pos").alias("step_index"), "state", "label")
