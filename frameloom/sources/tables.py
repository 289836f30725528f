"""Rows of a stored table as the frames of a manifest's task: generator `table`, whose parameters say what a frame is.

    {name: values, generator: table, seed: 7, pipeline: [normalizer, dedup],
     params: {extensions: {table: {path: /data/events.parquet, sample: user_id, order: [ts, event_id], cells: [value], shards: 64}}}}

sample is a column of whole numbers, order a total order of a sample's rows, cells a column of arrays or columns of one type. Samples
go to shards by a digest of their number, so a shard does not depend on what else the table holds. A null sample is a sample of its
own, null cells are 0 and a null array is a frame without cells. `where` is a condition that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from frameloom.errors import InvalidParams
from frameloom.model import as_frames

#: The name that a manifest's task gives where its frames come from a table.
TABLE = "table"
NEEDED = ("path", "sample", "order", "cells")


def problems(config: dict) -> list[str]:
    """What is wrong with a table's parameters, as far as can be told without reading it."""
    wrong = [f"table lacks {n}" for n in NEEDED if not config.get(n)]
    wrong += [f"table: {n} must be a list of columns" for n in ("order", "cells") if config.get(n) and not (isinstance(config[n], list) and all(isinstance(c, str) for c in config[n]))]
    shards = config.get("shards", 1)
    if isinstance(shards, bool) or not isinstance(shards, int) or shards < 1:
        wrong.append("table: shards must be a whole number of 1 or more")
    return wrong


def shard_of(sample: Column, shards: int) -> Column:
    """The shard of a sample, from the first 32 bits of a digest that SQL engines agree on."""
    return (F.conv(F.substring(F.md5(F.coalesce(sample.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def cells_of(rows: DataFrame, names: list[str]) -> Column:
    """The named columns as an array of bigint, double or boolean cells."""
    types = [rows.schema[n].dataType for n in names]
    array = len(types) == 1 and isinstance(types[0], T.ArrayType)
    cells = [types[0].elementType] if array else types
    if all(isinstance(t, T.BooleanType) for t in cells):
        kind, empty = "boolean", F.lit(False)
    elif all(isinstance(t, T.IntegralType) for t in cells):
        kind, empty = "bigint", F.lit(0).cast("bigint")
    elif all(isinstance(t, T.NumericType) for t in cells):
        kind, empty = "double", F.lit(0.0)
    else:
        raise InvalidParams(f"cells must be numbers or truth values, not {', '.join(t.simpleString() for t in cells)}")
    made = F.coalesce(F.col(names[0]), F.array().cast(types[0])) if array else F.array(*names)
    return F.transform(made.cast(f"array<{kind}>"), lambda x: F.coalesce(x, empty))


def table_frames(spark: SparkSession, config: dict, task: str, shards: int) -> DataFrame:
    """The frames of a table, whole samples in one of so many shards."""
    wrong = problems(config)
    if wrong:
        raise InvalidParams("; ".join(wrong))
    rows = spark.read.format(config.get("format", "parquet")).options(**config.get("options", {})).load(config["path"])
    needed = [config["sample"], *config["order"], *config["cells"], *([config["label"]] if config.get("label") else [])]
    missing = sorted({n for n in needed if n not in rows.columns})
    if missing:
        raise InvalidParams(f"the table lacks {', '.join(missing)}")
    if not isinstance(rows.schema[config["sample"]].dataType, T.IntegralType):
        raise InvalidParams(f"{config['sample']} must be a column of whole numbers")
    if config.get("where"):
        rows = rows.where(config["where"])
    label = F.col(config["label"]).cast("string") if config.get("label") else None
    frames = as_frames(rows, config["sample"], config["order"], cells_of(rows, config["cells"]), task, label)
    return frames.withColumn("shard_id", shard_of(F.col("sample_id"), shards))
