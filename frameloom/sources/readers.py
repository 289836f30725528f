"""Readers of files that the engine or its users have written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from frameloom.errors import InvalidParams, SerializationError
from frameloom.functions.frames import counted_digits
from frameloom.model import KINDS
from frameloom.sinks.files import CELL, MAGIC, VERSION, cells_as
from frameloom.sources.ranges import ArrayFiles, TokenFiles, read_ranges
from frameloom.workers import ship


def read_frames(spark: SparkSession, folder: str, tasks: list[str] | None = None) -> DataFrame:
    """Native Parquet frames; naming tasks reads only their folders."""
    frames = spark.read.parquet(folder)
    return frames if tasks is None else frames.where(F.col("task").isin(tasks))


def named(prefix: str = "", suffix: str = "") -> str:
    """A path filter (pathGlobFilter) for files whose names begin and end so; signs with a meaning in patterns are taken as they are."""
    plain = lambda t: "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in t)
    return f"{plain(prefix)}*{plain(suffix)}"


def read_tagged_parquet(spark: SparkSession, path: str, kind: str = "float", files: str = "*") -> DataFrame:
    """The compatible layout, its cells as the kind says: doubles, whole numbers with all their digits, or truth values.

    shard_id comes from the file's name, since sample ids restart in every shard. `files` filters names, as named() makes it.
    """
    ship(spark)
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5})_[0-9a-f]{16}\.", 1)
    rows = spark.read.option("pathGlobFilter", files).parquet(path).select("sample_id", "step_index", "state_dim", "state_values", "label", F.coalesce(F.try_to_number(F.when(shard != "", shard), F.lit("99999")), F.lit(0)).cast("int").alias("shard_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, sizes = batch.column("state_values").to_pylist(), batch.column("state_dim").to_numpy()
            if [len(b) // CELL.itemsize for b in cells] != sizes.tolist():
                raise SerializationError("a frame's cells are not as many as its state_dim")
            flat = cells_as(b"".join(cells), kind)
            states = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            columns = {"shard_id": batch.column("shard_id"), "sample_id": batch.column("sample_id"), "step_index": batch.column("step_index"), "state": states, "label": batch.column("label")}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"shard_id int, sample_id bigint, step_index bigint, state array<{KINDS[kind]}>, label string")


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_binary(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """Frames of binary shards, cells as the kind says; a shard is one file and is parsed by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                magic, version, frames, width = struct.unpack_from("<4sIQI", data)
                if magic != MAGIC or version != VERSION:
                    raise SerializationError(f"{name} is no binary shard")
                at, rows = 20, []
                for _ in range(frames):
                    sample = None
                    if data[at]:
                        sample = struct.unpack_from("<q", data, at + 1)[0]
                        at += 8
                    step = struct.unpack_from("<q", data, at + 1)[0]
                    at += 9
                    cells = cells_as(data[at : at + 9 * width], kind).to_pylist()
                    at += 9 * width
                    size = struct.unpack_from("<I", data, at)[0]
                    rows.append((name.rsplit("/", 1)[-1], sample, step, cells, data[at + 4 : at + 4 + size].decode() or None))
                    at += 4 + size
                yield pd.DataFrame(rows, columns=["filename", "sample_id", "step_index", "state", "label"])

    return _binary_files(spark, path).mapInPandas(run, f"filename string, sample_id bigint, step_index bigint, state array<{KINDS[kind]}>, label string")


def read_npy(spark: SparkSession, path: str, most: int | None = None, partition_bytes: int | None = None) -> DataFrame:
    """(filename, row, shape, values) for each first-axis row of arrays; `most` rows of the lowest file names and rows, if given."""
    return read_ranges(spark, ArrayFiles, path, most=most, partition_bytes=partition_bytes)


def read_token_words(spark: SparkSession, path: str, most: int | None = None, partition_bytes: int | None = None) -> DataFrame:
    """(filename, pos, token) of files of 16-bit tokens; `most` of them, if given."""
    return read_ranges(spark, TokenFiles, path, most=most, partition_bytes=partition_bytes)


def read_brackets(spark: SparkSession, path: str) -> DataFrame:
    """Lines of blank-separated numbers as arrays."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.cast("bigint")).alias("state"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def champernowne(spark: SparkSession, count: int, start: int, numbers: int) -> DataFrame:
    """(sample_id, state): the digits of `numbers` numbers in a row from start + sample on."""
    return spark.range(count).select(F.col("id").alias("sample_id"), counted_digits(F.col("id") + start, numbers).alias("state"))


def brackets(spark: SparkSession, count: int, symbols: int, length: int, seed: int, shuffled: bool = False, p_open: float = 0.5, min_depth: int = 1, max_depth: int | None = None, early_end: bool = False) -> DataFrame:
    """(sample_id, state): balanced sequences of an even length; shuffled ones balance each symbol on its own.

    A sequence begins with min_depth opening brackets and is never deeper than max_depth. With early_end it is over as soon as
    nothing is open, so it may be shorter.
    """
    ship(spark)
    deepest = length // 2 if max_depth is None else max_depth
    if length % 2 or symbols < 1:
        raise InvalidParams("length must be even and there must be a symbol")
    if not 0 < min_depth <= deepest or 2 * min_depth > length:
        raise InvalidParams("min_depth must be positive, at most max_depth, and at most half the length")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for i in part["id"]:
                rng = np.random.default_rng([seed, int(i)])
                open_, out = [], []
                while len(out) < length:
                    left = length - len(out)
                    begins = len(out) < min_depth or not open_
                    if begins or (len(open_) < min(left, deepest) and rng.random() < p_open):
                        s = int(rng.integers(symbols))
                        open_.append(s)
                        out.append(s)
                    else:
                        at = int(rng.integers(len(open_))) if shuffled else -1
                        out.append(open_.pop(at) + symbols)
                        if early_end and not open_:
                            break
                made.append(out)
            yield pd.DataFrame({"sample_id": part["id"], "state": made})

    return spark.range(count).mapInPandas(run, "sample_id bigint, state array<bigint>")


def write_brackets(sequences: DataFrame, path: str) -> None:
    """Sequences as lines of blank-separated numbers, which read_brackets reads."""
    sequences.select(F.array_join(F.transform("state", lambda x: x.cast("string")), " ").alias("value")).write.mode("append").text(path)
