"""File sinks: one file for each shard, on any store that all executors reach.

A task writes whole shards, and frames stream through it in order, with the header first. Each attempt of a task writes a file of
its own in a folder of the job's; only files that the job's rows name, those of the attempts that counted, are moved to their
names, by the driver. So a lost executor or a second attempt leaves nothing half written under a shard's name, and a job that
runs again puts the same files in the places of the first. The same files can be had from `df.write.format("frameloom")`, see
FrameWriter. Folders of Parquet and text without shards go through Spark's own writers, which replace a task's folder as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from frameloom.errors import InvalidParams, SerializationError, SinkError
from frameloom.functions import frames as X
from frameloom.functions.seeds import shard_seed
from frameloom.lineage import broadcast_if_few, checkpointed
from frameloom.model import kind_of
from frameloom.registry import Registry
from frameloom.workers import ship

#: File extensions by format.
FORMATS: dict[str, str] = {}
#: The binary format's magic and version, and the tags of its cells.
MAGIC, VERSION = b"SGEN", 2
TAGS = {"int": 1, "float": 2, "bool": 3}
CELL = np.dtype([("tag", "u1"), ("value", "<i8")])
RESULT = "task string, shard_id int, seed bigint, filename string, format string, samples bigint, frames bigint, bytes bigint, sha256 string, error string"
#: Formats that write_shards knows; register_sink adds more.
SHARDS: Registry[type] = Registry("sink")


def register_sink(name: str, extension: str):
    """Make a class of shards known by a name: made with (write, kind, options, frames), then write() for each frame, then close()."""

    def wrap(made: type) -> type:
        SHARDS.register(name, made)
        FORMATS[name] = extension
        return made

    return wrap


def rooted(folder: str) -> str:
    """A folder as every process finds it: an address, or an absolute path."""
    return folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    try:
        return fs.FileSystem.from_uri(rooted(folder))
    except (pa.ArrowInvalid, OSError) as e:
        raise SinkError(f"no store for {folder!r}: {e}") from e


def file_name(task: str, shard: int, seed: int, extension: str) -> str:
    return f"{task}_{shard:05d}_{seed % (1 << 64):016x}.{extension}"


def encode_cells(values: np.ndarray, kind: str) -> bytes:
    """Nine bytes a cell: a tag and eight bytes, low ones first."""
    out = np.zeros(len(values), CELL)
    out["tag"] = TAGS[kind]
    out["value"] = np.asarray(values, np.float64).view(np.int64) if kind == "float" else np.asarray(values).astype(np.int64)
    return out.tobytes()


def cells_as(data: bytes, kind: str) -> pa.Array:
    """The cells of encode_cells, mixed tags too, all as one kind."""
    cells = np.frombuffer(data, CELL)
    tag, whole = cells["tag"], cells["value"].copy()
    if not np.isin(tag, list(TAGS.values())).all():
        raise SerializationError("a cell has an unknown tag")
    whole = np.where(tag == TAGS["bool"], whole & 0xFF, whole)
    floats = cells["value"].copy().view(np.float64)
    if kind == "float":
        return pa.array(np.where(tag == TAGS["float"], floats, whole.astype(np.float64)))
    if kind == "bool":
        return pa.array(np.where(tag == TAGS["float"], floats != 0, whole != 0))
    if (tag == TAGS["float"]).any() and not (floats[tag == TAGS["float"]] == np.trunc(floats[tag == TAGS["float"]])).all():
        raise SerializationError("a cell is no whole number")
    return pa.array(np.where(tag == TAGS["float"], np.where(tag == TAGS["float"], floats, 0).astype(np.int64), whole))


class Shard:
    """Frames of one width, behind a header that tells their number, which is known before the first."""

    def __init__(self, write, kind: str, options: dict, frames: int):
        self.out, self.kind, self.options, self.frames, self.width, self.done = write, kind, options, frames, None, 0

    def header(self) -> bytes:
        raise NotImplementedError

    def frame(self, sample, step, cells, label) -> bytes:
        raise NotImplementedError

    def write(self, sample, step, cells, label) -> None:
        if self.width is None:
            self.width = len(cells)
            self.out(self.header())
        if len(cells) != self.width:
            raise SinkError(f"frames of {len(cells)} and of {self.width} cells cannot share a file")
        self.out(self.frame(sample, step, cells, label))
        self.done += 1

    def close(self) -> None:
        if self.done != self.frames:
            raise SinkError(f"{self.done} frames came and {self.frames} were announced")


@register_sink("Binary", "bin")
class BinaryShard(Shard):
    """Magic, version, frames and width, then the frames."""

    def header(self) -> bytes:
        return struct.pack("<4sIQI", MAGIC, VERSION, self.frames, self.width)

    def frame(self, sample, step, cells, label) -> bytes:
        head = b"\0" if sample is None else struct.pack("<BQ", 1, sample % (1 << 64))
        name = (label or "").encode()
        return head + struct.pack("<Q", step) + encode_cells(np.asarray(cells), self.kind) + struct.pack("<I", len(name)) + name


@register_sink("Npy", "npy")
class ArrayShard(Shard):
    """An array of (frames, cells)."""

    HEADER = 128
    TYPES = {"int": "<i8", "float": "<f8", "bool": "|b1"}

    def shape(self) -> tuple[int, ...]:
        return self.frames, self.width

    def header(self) -> bytes:
        text = repr({"descr": np.dtype(self.TYPES[self.kind]).str, "fortran_order": False, "shape": self.shape()})
        room = self.HEADER - 10
        if len(text) >= room:
            raise SinkError("the array's shape does not fit its header")
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", room) + text.ljust(room - 1).encode() + b"\n"

    def frame(self, sample, step, cells, label) -> bytes:
        return np.asarray(cells).astype(self.TYPES[self.kind]).tobytes()


@register_sink("NpyBatch", "npy")
class BatchArrayShard(ArrayShard):
    """An array of (samples, frames, ...): cells as rows x cols x channels where these are given, else flat."""

    TYPES = {"int": "<i4", "float": "<f8", "bool": "<i4"}

    def shape(self) -> tuple[int, ...]:
        per = int(self.options.get("num_frames") or self.frames)
        if self.frames % per:
            raise SinkError(f"{self.frames} frames are no whole number of samples of {per}")
        grid = [self.options.get(n) for n in ("rows", "cols", "channels")]
        cells = tuple(int(g) for g in grid) if all(grid) else (self.width,)
        if int(np.prod(cells)) != self.width:
            raise SinkError(f"{self.width} cells do not make a grid of {cells}")
        return (self.frames // per, per, *cells)


class _Out:
    """What a library that wants a file writes to."""

    closed = False

    def __init__(self, write):
        self.out, self.at = write, 0

    def write(self, data) -> int:
        data = bytes(data)
        self.out(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


@register_sink("Parquet", "parquet")
class ParquetShard(Shard):
    """The five columns with tagged cells as bytes, in row groups of bounded size; option compression (snappy by default)."""

    SCHEMA = pa.schema([("sample_id", pa.int64()), pa.field("step_index", pa.int64(), False), pa.field("state_dim", pa.int32(), False), pa.field("state_values", pa.binary(), False), ("label", pa.string())])
    ROWS = 4096

    def __init__(self, write, kind: str, options: dict, frames: int):
        super().__init__(write, kind, options, frames)
        self.rows: list[tuple] = []
        self.file = pq.ParquetWriter(pa.PythonFile(_Out(write), "w"), self.SCHEMA, compression=options.get("compression", "snappy"))

    def write(self, sample, step, cells, label) -> None:
        self.rows.append((sample, step, len(cells), encode_cells(np.asarray(cells), self.kind), label))
        self.done += 1
        if len(self.rows) >= self.ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.file.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.SCHEMA.types, strict=True)], schema=self.SCHEMA))
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.file.close()
        super().close()


@register_sink("Text", "txt")
class TextShard(Shard):
    """A line for each frame: its characters, behind the sample's number where the option with_sample is set, before its label."""

    def write(self, sample, step, cells, label) -> None:
        head = f"{sample}:" if self.options.get("with_sample") and sample is not None else ""
        self.out(f"{head}{self.characters(cells)}{'' if label is None else ' ' + label}\n".encode())
        self.done += 1

    def characters(self, cells) -> str:
        if self.kind == "bool":
            return "".join("1" if c else "0" for c in cells)
        points = [int(min(max(c, 0.0), 255.0)) if c == c else 0 for c in cells] if self.kind == "float" else [int(c) for c in cells]
        return "".join(chr(p) if 0 <= p <= X.LAST_CODEPOINT and not 0xD800 <= p <= 0xDFFF else chr(X.REPLACEMENT) for p in points)


class Attempt:
    """A file of one attempt of a task, in the job's folder, with its size and digest."""

    def __init__(self, folder: str, job: str, name: str):
        self.fs, root = store(folder)
        self.fs.create_dir(f"{root}/{job}", recursive=True)
        self.name = f"{job}/{name}.{uuid4().hex}"
        self.path = f"{root}/{self.name}"
        self.stream, self.size, self.digest = self.fs.open_output_stream(self.path), 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)

    def drop(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.path)


def committed(folder: str, job: str, made: DataFrame, name: str, final: str) -> list[dict]:
    """Run a job, a row for each file, and move the files that its rows name; what other attempts wrote goes with the job's folder."""
    where, root = store(folder)
    try:
        rows = [r.asDict() for r in made.collect()]  # a row for each file
        for row in rows:
            if row[name] is not None:
                where.move(f"{root}/{row[name]}", f"{root}/{row[final]}")
        return rows
    finally:
        if where.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{job}")


#: A row for each file of a job: RESULT, and the file that its attempt wrote.
FILE = RESULT + ", attempt string"
FILE_NAMES = [f.split()[0] for f in FILE.split(", ")]
FILE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


@dataclass
class ShardFiles:
    """How the frames of a partition, whole shards one after another, become files. The sink is looked up here, on the driver: what a
    user registers there, workers need not know."""

    folder: str
    fmt: str
    kind: str
    base_seed: int = 0
    options: dict = field(default_factory=dict)
    job: str = field(default_factory=lambda: f"_job-{uuid4().hex}")

    def __post_init__(self) -> None:
        self.sink, self.extension = SHARDS.get(self.fmt), FORMATS[self.fmt]

    def finish(self, task, shard, state) -> tuple:
        made, file, name, samples, error = state
        if error is None:
            try:
                made.close()
            except (SinkError, ValueError, OSError, pa.ArrowInvalid) as e:
                error = f"{type(e).__name__}: {e}"
        seed = int(np.uint64(shard_seed(self.base_seed, shard)).view(np.int64))
        if error is not None:
            file.drop()
            return task, shard, seed, None, self.fmt, samples, 0, 0, None, error, None
        file.stream.close()
        return task, shard, seed, name, self.fmt, samples, made.done, file.size, file.digest.hexdigest(), None, file.name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A row of FILE for each shard of batches (task, shard_id, sample_id, step_index, state, label, frames of the shard)."""
        key, state, last = None, None, None
        for batch in batches:
            for task, shard, sample, step, cells, label, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (task, shard) != key:
                    if key is not None:
                        yield self.finish(*key, state)
                    key, last = (task, shard), None
                    name = file_name(task, shard, int(shard_seed(self.base_seed, shard)), self.extension)
                    file = Attempt(self.folder, self.job, name)
                    state = [self.sink(file.write, self.kind, self.options, n), file, name, 0, None]
                if state[4] is None:
                    try:
                        state[0].write(sample, step, cells, label)
                    except (SinkError, ValueError, OSError, pa.ArrowInvalid) as e:
                        state[4] = f"{type(e).__name__}: {e}"
                state[3] += sample != last
                last = sample
        if key is not None:
            yield self.finish(*key, state)


def by_shards(frames: DataFrame) -> DataFrame:
    """frames as the sinks take them: each shard whole in one partition and in order, with how many frames it has.

    frames are read twice, once to count each shard's: materialise what is costly to make.
    """
    counts = checkpointed(frames.groupBy(F.col("task").alias("_task"), F.col("shard_id").alias("_shard")).agg(F.count(F.lit(1)).alias("shard_frames")))
    told = frames.join(broadcast_if_few(counts), F.col("task").eqNullSafe(F.col("_task")) & (F.col("shard_id") == F.col("_shard")))
    ordered = told.repartition("task", "shard_id").sortWithinPartitions("task", "shard_id", "sample_id", "pos")
    return ordered.select("task", "shard_id", "sample_id", "step_index", "state", "label", "shard_frames")


def write_shards(frames: DataFrame, folder: str, fmt: str, base_seed: int = 0, options: dict | None = None) -> DataFrame:
    """Write a file for each (task, shard) in a format of SHARDS; a row of RESULT for each, with its error if it failed.

    A shard has the same name each time, so a job that runs again replaces its files. frames are read twice (see by_shards).
    """
    if fmt not in SHARDS:
        raise InvalidParams(f"no sink {fmt!r} here")
    spark, folder = frames.sparkSession, rooted(folder)
    ship(spark)
    made = ShardFiles(folder, fmt, kind_of(frames), base_seed, options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(made(batches))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FILE_TYPES, strict=True)], names=FILE_NAMES)

    rows = committed(folder, made.job, by_shards(frames).mapInArrow(run, FILE), "attempt", "filename")
    return spark.createDataFrame([tuple(r[n] for n in FILE_NAMES[:-1]) for r in rows], RESULT)


@dataclass
class Written(WriterCommitMessage):
    """What a task of FrameWriter has written: rows of FILE."""

    rows: list


class FrameWriter(DataSourceArrowWriter):
    """`by_shards(frames).write.format("frameloom").mode("append").option("sink", "Npy").save(folder)`: a file for each shard.

    Options: sink (a name of SHARDS, Parquet by default), seed, and what the sink knows. A shard's file takes the place of one of the
    same name. mode("overwrite") also deletes the other files of the tasks that were written, and of no other task. An aborted
    job, and one with a shard that fails, leaves nothing.
    """

    def __init__(self, options: dict, kind: str, overwrite: bool):
        given = dict(options)
        if "path" not in given:
            raise SinkError("a folder to save to is missing")
        fmt = given.get("sink", "Parquet")
        if fmt not in SHARDS:
            raise InvalidParams(f"no sink {fmt!r} here")
        self.files = ShardFiles(rooted(given["path"]), fmt, kind, int(given.get("seed", 0)), {k: v for k, v in given.items() if k not in ("path", "sink", "seed")})
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(list(self.files(iterator)))

    def _end(self) -> None:
        where, root = store(self.files.folder)
        if where.get_file_info(f"{root}/{self.files.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.files.job}")

    def commit(self, messages: list) -> None:
        where, root = store(self.files.folder)
        rows = [dict(zip(FILE_NAMES, r, strict=True)) for m in messages if m is not None for r in m.rows]  # a row for each file
        failed = [f"{r['task']} {r['shard_id']}: {r['error']}" for r in rows if r["error"] is not None]
        if failed:
            self._end()
            raise SinkError(f"{len(failed)} shards failed, nothing is written: {'; '.join(failed[:5])}")
        where.create_dir(root, recursive=True)
        for r in rows:
            where.move(f"{root}/{r['attempt']}", f"{root}/{r['filename']}")
        if self.overwrite:
            names, tasks = {r["filename"] for r in rows}, {r["task"] for r in rows}
            for f in where.get_file_info(fs.FileSelector(root)):
                shard = re.fullmatch(r"(.*)_\d{5,}_[0-9a-f]{16}\.\w+", f.base_name)
                if f.type == fs.FileType.File and shard and shard[1] in tasks and f.base_name not in names:
                    where.delete_file(f.path)
        self._end()

    def abort(self, messages: list) -> None:
        self._end()


def write_parquet(frames: DataFrame, folder: str, compression: str = "snappy") -> None:
    """Native arrays in a folder for each task; the folders of the tasks that are written are replaced."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("task").parquet(folder)


def write_compatible_parquet(frames: DataFrame, folder: str) -> None:
    """The five columns with tagged cells as bytes, for readers of that layout."""
    ship(frames.sparkSession)
    kind = kind_of(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sample, step, state, label = batch.columns
            cells = [encode_cells(np.asarray(v), kind) for v in state.to_pylist()]
            yield pa.RecordBatch.from_arrays([sample, step, pa.array([len(c) // CELL.itemsize for c in cells], pa.int32()), pa.array(cells, pa.binary()), label], names=["sample_id", "step_index", "state_dim", "state_values", "label"])

    rows = frames.select("sample_id", "step_index", "state", "label")
    rows.mapInArrow(run, "sample_id bigint, step_index bigint, state_dim int, state_values binary, label string").write.mode("overwrite").parquet(folder)


def text_lines(frames: DataFrame, with_sample: bool = False):
    """[sample:]characters[ label] in one column, value."""
    head = F.concat(F.col("sample_id").cast("string"), F.lit(":")) if with_sample else F.lit("")
    tail = F.when(F.col("label").isNotNull(), F.concat(F.lit(" "), "label")).otherwise(F.lit(""))
    return frames.select("task", "shard_id", "sample_id", "pos", F.concat(head, X.text_of(F.col("state"), kind_of(frames)), tail).alias("value"))


def write_text(frames: DataFrame, folder: str, with_sample: bool = False) -> None:
    """Lines in a folder for each task; the folders of the tasks that are written are replaced."""
    lines = text_lines(frames, with_sample).repartition("task", "shard_id").sortWithinPartitions("task", "shard_id", "sample_id", "pos")
    lines.select("task", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").text(folder)


def write_token_words(tokens: DataFrame, folder: str, per_file: int = 1 << 24, shard: str | None = None) -> int:
    """(pos, token) as files of little-endian 16-bit tokens, each holding a stretch of positions in order; the number of files.

    With `shard` a column names the file that a token goes to. The files of one call appear together or not at all.
    """
    spark, folder = tokens.sparkSession, rooted(folder)
    ship(spark)
    job = f"_job-{uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now, out = None, None, []
        for batch in batches:
            stretch, token = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(token) and (token.min() < 0 or token.max() > 0xFFFF):
                raise SinkError("tokens above 65535 do not fit 16 bits")
            for s in np.unique(stretch):
                if s != now:
                    if file:
                        file.stream.close()
                    now, name = s, f"tokens_{s:05d}.bin"
                    file = Attempt(folder, job, name)
                    out.append((name, file.name))
                file.write(token[stretch == s].astype("<u2").tobytes())
        if file:
            file.stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["filename", "attempt"])

    stretch = F.floor(F.col("pos") / per_file) if shard is None else F.col(shard)
    placed = tokens.select(stretch.cast("bigint").alias("stretch"), "token", "pos")
    ordered = placed.repartition("stretch").sortWithinPartitions("stretch", "pos").select("stretch", "token")
    return len(committed(folder, job, ordered.mapInArrow(run, "filename string, attempt string"), "attempt", "filename"))


def write_report(rows: DataFrame, path: str) -> None:
    """The few rows of a report as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size, sha256) of files, on any store."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
