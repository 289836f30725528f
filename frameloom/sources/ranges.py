"""Readers of flat files by byte ranges: planning reads headers only, and a large file is read by many tasks.

`spark.read.format("frameloom-npy")` gives a row for each first-axis row of arrays, `format("frameloom-tokens")` one for each 16-bit
token. A partition is a stretch of rows of one file; it seeks to its place and streams batches of bounded size. Filters on the
file's name and on a row's place are taken over by the plan, and a cap on rows ends the listing, so that files behind it are
never opened.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from frameloom.errors import InvalidParams, SerializationError
from frameloom.sinks.files import store
from frameloom.workers import ship

#: Bytes of a partition, about, and of a batch.
PART, BATCH = 64 << 20, 4 << 20


@dataclass
class Stretch(InputPartition):
    """Rows first .. last-1 of a file, whose rows of `step` bytes begin at `start`."""

    path: str
    name: str
    start: int
    step: int
    first: int
    last: int
    dtype: str
    shape: tuple[int, ...]


def listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder, of one path, or of a pattern in the last part of a path, by name."""
    where, root = store(path)
    found = where.get_file_info(root)
    if found.type == fs.FileType.File:
        return where, [found]
    folder, pattern = (root, "*") if found.type == fs.FileType.Directory else root.rsplit("/", 1)
    files = [f for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and f.base_name[0] not in "._"]
    if not files and found.type == fs.FileType.NotFound:
        raise SerializationError(f"no file {path!r}")
    return where, sorted(files, key=lambda f: f.base_name)


class RangeReader(DataSourceReader):
    """Plans stretches of files. `place` is the column that counts a file's rows; the other column filters know is filename."""

    place = "row"

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options["most"]) if "most" in options else None
        self.part = int(options.get("partition_bytes", PART))
        if self.part < 1 or (self.most is not None and self.most < 0):
            raise InvalidParams("partition_bytes must be positive and most not negative")
        self.names: set[str] | None = None
        self.low, self.high = 0, None
        self.opened = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column == "filename" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif column == self.place and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    last = f.value + (not isinstance(f, LessThan))
                    self.high = last if self.high is None else min(self.high, last)
            else:
                yield f

    def layout(self, where: fs.FileSystem, file: fs.FileInfo) -> tuple[int, int, int, str, tuple[int, ...]]:
        """Where rows begin, their bytes, their number, type and shape."""
        raise NotImplementedError

    def partitions(self) -> list[Stretch]:
        where, files = listed(self.path)
        made, left = [], self.most
        for file in files:
            if left == 0:
                break
            if self.names is not None and file.base_name not in self.names:
                continue
            start, step, rows, dtype, shape = self.layout(where, file)
            self.opened += 1
            rows = rows if left is None else min(rows, left)
            left = None if left is None else left - rows
            first, last = self.low, rows if self.high is None else min(rows, self.high)
            per = max(1, self.part // max(1, step))
            made += [Stretch(file.path, file.base_name, start, step, at, min(last, at + per), dtype, shape) for at in range(first, last, per)]
        return made

    def batches(self, p: Stretch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) of a stretch, some MB at a time."""
        where, _ = store(self.path)
        per = max(1, BATCH // max(1, p.step))
        with where.open_input_file(p.path) as file:
            for at in range(p.first, p.last, per):
                n = min(per, p.last - at)
                file.seek(p.start + at * p.step)
                data = file.read(n * p.step)
                if len(data) != n * p.step:
                    raise SerializationError(f"{p.name} ends before row {at + n}")
                yield at, np.frombuffer(data, np.dtype(p.dtype)).reshape(n, -1)


class ArrayReader(RangeReader):
    """Arrays in row order; one in column order, whose rows lie scattered, is refused."""

    def layout(self, where, file):
        with where.open_input_file(file.path) as stream:
            version = np.lib.format.read_magic(stream)
            shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
            start = stream.tell()
        if dtype.hasobject or not shape:
            raise SerializationError(f"{file.base_name} has no rows of numbers")
        if by_column and len(shape) > 1:
            raise SerializationError(f"{file.base_name} is in column order")
        return start, dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64)), shape[0], dtype.str, tuple(shape[1:])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for at, rows in self.batches(partition):
            n, width = rows.shape if rows.size else (len(rows), 0)
            lists = lambda values, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), values)
            shape = pa.array(np.tile(np.array(partition.shape, np.int32), n), pa.int32())
            values = pa.array(rows.reshape(-1).astype(float), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array(np.arange(at, at + n)), lists(shape, len(partition.shape)), lists(values, width)], names=["filename", "row", "shape", "values"])


class TokenReader(RangeReader):
    place = "pos"

    def layout(self, where, file):
        if file.size % 2:
            raise SerializationError(f"{file.base_name} holds no whole number of tokens")
        return 0, 2, file.size // 2, "<u2", ()

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for at, rows in self.batches(partition):
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array(np.arange(at, at + n)), pa.array(rows.reshape(-1).astype(np.int64))], names=["filename", "pos", "token"])


class _Files(DataSource):
    READER: type[RangeReader]

    def reader(self, schema) -> RangeReader:
        if "path" not in self.options:
            raise InvalidParams("a path is missing")
        return self.READER(dict(self.options))


class ArrayFiles(_Files):
    """Options path, most (rows in all, of the lowest file names and rows), partition_bytes."""

    READER = ArrayReader

    @classmethod
    def name(cls) -> str:
        return "frameloom-npy"

    def schema(self) -> str:
        return "filename string, row bigint, shape array<int>, values array<double>"


class TokenFiles(_Files):
    """Options path, most (tokens in all), partition_bytes."""

    READER = TokenReader

    @classmethod
    def name(cls) -> str:
        return "frameloom-tokens"

    def schema(self) -> str:
        return "filename string, pos bigint, token bigint"


def read_ranges(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    """path through a source of this module, with filters handed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)
