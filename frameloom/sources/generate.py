"""Generated frames as DataFrames, in batch and as a Python data source for batch and streaming reads.

Rows of (shard, sample) are made by Catalyst; seeds depend on these alone, so the number of partitions never changes a frame.
A shard that fails gives one row with its error instead of failing the job.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from frameloom.errors import GenerationError, InvalidParams
from frameloom.functions.seeds import sample_seed, shard_seed
from frameloom.model import schema
from frameloom.sinks.files import FrameWriter
from frameloom.sources.kernels import GENERATORS, sample_frames
from frameloom.workers import ship

#: Cells that a worker holds at a time, about: batches of samples are cut accordingly.
CELLS = 4_000_000
ARROW = {"int": pa.int64(), "float": pa.float64(), "bool": pa.bool_()}


def _batch(task: str, shard: int, ids: np.ndarray, steps: np.ndarray, flat, offsets: np.ndarray, kind: str) -> pa.RecordBatch:
    n = len(ids)
    states = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, ARROW[kind]))
    columns = [pa.array([task] * n, pa.string()), pa.array(np.full(n, shard, np.int32)), pa.array(ids, pa.int64()), pa.array(steps, pa.int64()), pa.array(steps, pa.int64()), states, pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["task", "shard_id", "sample_id", "pos", "step_index", "state", "label"])


def shard_batches(task: str, generator: str, config: dict, steps: int, base_seed: int, shard: int, samples: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Frames of some samples of a shard, in batches of bounded size."""
    kernel = GENERATORS.get(generator)(config)
    if not steps and kernel.endless:
        raise InvalidParams("an endless sample cannot be read as a table; give seq_length")
    seeds = sample_seed(shard_seed(base_seed, shard), samples)
    if kernel.ragged:
        for i, seed in zip(samples, seeds, strict=True):
            frames = sample_frames(kernel, int(seed), steps)
            begun = 0
            while chunk := list(islice(frames, 1024)):
                sizes = np.array([len(f) for f in chunk])
                at = np.arange(begun, begun + len(chunk))
                yield _batch(task, shard, np.full(len(chunk), i), at, [c for f in chunk for c in f], np.concatenate([[0], np.cumsum(sizes)]), kernel.kind)
                begun += len(chunk)
        return
    width = next(kernel.run(seeds[:1])).shape[1] if len(seeds) else 1
    together = max(1, min(len(samples), CELLS // max(1, width * min(steps, 64))))
    for lo in range(0, len(samples), together):
        ids = samples[lo : lo + together]
        run = islice(kernel.run(seeds[lo : lo + together]), steps)
        begun = 0
        while grids := list(islice(run, 64)):
            cube = np.stack(grids, axis=1)
            n, t, w = cube.shape
            yield _batch(task, shard, np.repeat(ids, t), np.tile(np.arange(begun, begun + t), n), cube.reshape(-1), np.arange(n * t + 1) * w, kernel.kind)
            begun += t


def generate(spark: SparkSession, generator: str, config: dict | None = None, count: int = 1, seq_length: int = 16, seed: int = 0, task: str = "task", shard_size: int | None = None, partitions: int | None = None, isolate: bool = False) -> DataFrame:
    """Frames of `count` samples of a generator. sample_id restarts at 0 in every shard; KEY tells samples apart.

    With isolate there is a further column, error: a shard that fails adds a row without state that says why, and the others
    go on.
    """
    ship(spark)
    config = config or {}
    kernel = GENERATORS.get(generator)(config)  # rejects wrong parameters here rather than in a task
    if count < 0 or seq_length < 0:
        raise InvalidParams("count and seq_length must not be negative")
    if not seq_length and kernel.endless:
        raise InvalidParams("an endless sample cannot be read as a table; give seq_length")
    size = shard_size or count or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for shard in np.unique(ids // size):
                own = ids[ids // size == shard] - shard * size
                if not isolate:
                    try:
                        yield from shard_batches(task, generator, config, seq_length, seed, int(shard), own)
                    except Exception as e:
                        raise GenerationError(f"shard {shard} of {task}: {type(e).__name__}: {e}") from e
                    continue
                try:
                    for made in shard_batches(task, generator, config, seq_length, seed, int(shard), own):
                        yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.string())], names=[*made.schema.names, "error"])
                except Exception as e:  # whatever a generator raises is the shard's result
                    row = [pa.array([task]), pa.array([shard], pa.int32()), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(ARROW[kernel.kind]), pa.string())], pa.array([f"{type(e).__name__}: {e}"])]
                    yield pa.RecordBatch.from_arrays(row, names=["task", "shard_id", "sample_id", "pos", "step_index", "state", "label", "error"])

    columns = schema(kernel.kind) + (", error string" if isolate else "")
    return spark.range(0, count, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, columns)


#: Blocks of samples whose generators a worker keeps between micro-batches, at most.
KEPT = 32
_LIVE: OrderedDict[tuple[str, int], tuple[int, Iterator]] = OrderedDict()


def block_steps(plan: dict, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step the numbers of the samples that go on, their cells one after another, and how many each has."""
    kernel = GENERATORS.get(plan["generator"])(plan["config"])
    shards = ids // plan["size"]
    seeds = sample_seed(shard_seed(plan["seed"], shards), ids - shards * plan["size"])
    if not kernel.ragged:
        for grid in kernel.run(seeds):
            yield ids, grid.reshape(-1), np.full(len(ids), grid.shape[1])
        return
    alive = [(i, sample_frames(kernel, int(seed), plan["steps"])) for i, seed in zip(ids, seeds, strict=True)]
    while alive:
        made = [(i, frames, state) for i, frames in alive if (state := next(frames, None)) is not None]
        alive = [(i, frames) for i, frames, _ in made]
        yield np.array([i for i, _, _ in made], np.int64), np.array([c for _, _, s in made for c in s]), np.array([len(s) for _, _, s in made], np.int64)


def endless_batches(key: str, block: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """The steps start .. stop - 1 of a block of samples, in batches of bounded size; key is the plan as JSON.

    A worker that made the steps before goes on from there; any other runs the block anew up to `start`, with the same frames.
    """
    plan = json.loads(key)
    at, steps = _LIVE.pop((key, block), (-1, None))
    if at != start:
        lo, hi = (plan["count"] * b // plan["blocks"] for b in (block, block + 1))
        steps = block_steps(plan, np.arange(lo, hi))
        next(islice(steps, start, start), None)
    kind, held, cells = GENERATORS.get(plan["generator"])(plan["config"]).kind, [], 0

    def batch() -> pa.RecordBatch:
        ids = np.concatenate([i for _, (i, _, _) in held])
        at = np.concatenate([np.full(len(i), step) for step, (i, _, _) in held])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, (_, _, n) in held]))])
        shards = ids // plan["size"]
        return _batch(plan["task"], shards, ids - shards * plan["size"], at, np.concatenate([c for _, (_, c, _) in held]), offsets, kind)

    for step in range(start, min(stop, plan["steps"]) if plan["steps"] else stop):
        made = next(steps, None)
        if made is None:
            break
        if len(made[0]):
            held.append((step, made))
            cells += len(made[1])
        if cells >= CELLS:
            yield batch()
            held, cells = [], 0
    if held:
        yield batch()
    _LIVE[(key, block)] = (stop, steps)
    while len(_LIVE) > KEPT:
        _LIVE.popitem(last=False)


def generate_stream(spark: SparkSession, generator: str, config: dict | None = None, count: int = 1, frames_per_batch: int = 16, seq_length: int = 0, seed: int = 0, task: str = "task", shard_size: int | None = None, blocks: int | None = None) -> DataFrame:
    """Frames of endless samples as a stream whose rows the executors make: each micro-batch goes on by frames_per_batch steps.

    Spark's own source numbers the micro-batches, so what a batch holds follows from its number alone: a stream that is started
    again from its checkpoint goes on where it was, and a batch that is read again has the same frames. Samples are dealt to
    `blocks`, a task each. A trigger sets the pace, and a batch's size is fixed: count * frames_per_batch frames at most. Samples
    that end, and all of them after seq_length steps, give no more frames.
    """
    ship(spark)
    kernel = GENERATORS.get(generator)(config or {})
    if count < 1 or seq_length < 0 or frames_per_batch < 1:
        raise InvalidParams("count and frames_per_batch must be positive, and seq_length not negative")
    parts = max(1, min(count, blocks or spark.sparkContext.defaultParallelism))
    key = json.dumps({"generator": generator, "config": config or {}, "count": count, "steps": seq_length, "seed": seed, "task": task, "size": shard_size or count, "blocks": parts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                turn, block = divmod(value, parts)
                yield from endless_batches(key, block, turn * frames_per_batch, (turn + 1) * frames_per_batch)

    turns = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=str(parts), numPartitions=str(parts)).load()
    return turns.select("value").mapInArrow(run, schema(kernel.kind))


class FrameSource(DataSource):
    """format("frameloom"): options generator, config (JSON), count, seq_length, seed, task, shard_size, frames_per_batch to read;
    sink, seed and those of a sink to write (see FrameWriter)."""

    @classmethod
    def name(cls) -> str:
        return "frameloom"

    def _plan(self) -> dict:
        o = self.options
        return {"generator": o.get("generator", "ca"), "config": json.loads(o.get("config", "{}")), "steps": int(o.get("seq_length", 0)), "seed": int(o.get("seed", 0)), "task": o.get("task", "task"), "count": int(o.get("count", 1)), "size": int(o.get("shard_size", 0))}

    def schema(self) -> str:
        plan = self._plan()
        return schema(GENERATORS.get(plan["generator"])(plan["config"]).kind)

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self._plan())

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        cell = schema["state"].dataType.elementType.typeName()
        return FrameWriter(self.options, {"double": "float", "float": "float", "boolean": "bool"}.get(cell, "int"), overwrite)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return EndlessReader(self._plan(), int(self.options.get("frames_per_batch", 16)))


class ShardReader(DataSourceReader):
    """A partition for each shard."""

    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        size = self.plan["size"] or max(1, self.plan["count"])
        return [InputPartition(i) for i in range(-(-self.plan["count"] // size))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = self.plan
        size = p["size"] or max(1, p["count"])
        n = min(size, p["count"] - partition.value * size)
        return shard_batches(p["task"], p["generator"], p["config"], p["steps"], p["seed"], partition.value, np.arange(n))


class EndlessReader(SimpleDataSourceStreamReader):
    """Frames of a few endless samples, so many steps a batch; the offset is the next step, so a replay gives the same frames. The
    rows are made where the stream is planned: generate_stream has the executors make them.

    The samples' generators live on between batches, so a batch costs its own steps alone. Only after a restart, or where a batch
    is read again, are they run anew up to where it begins.
    """

    def __init__(self, plan: dict, per_batch: int):
        self.plan, self.per_batch = plan, per_batch
        self.live, self.at = None, 0

    def initialOffset(self) -> dict:
        return {"step": 0}

    def _samples(self, start: int) -> list:
        p = self.plan
        kernel = GENERATORS.get(p["generator"])(p["config"])
        made = [sample_frames(kernel, int(sample_seed(shard_seed(p["seed"], 0), i)), 0) for i in range(p["count"])]
        for frames in made:
            next(islice(frames, start, start), None)
        return made

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        p = self.plan
        stop = min(end, p["steps"]) if p["steps"] else end
        if self.live is None or self.at != start:
            self.live = self._samples(start)
        rows = []
        for i, frames in enumerate(self.live):
            for t, state in enumerate(islice(frames, max(0, stop - start)), start):
                rows.append((p["task"], 0, i, t, t, [x.item() if isinstance(x, np.generic) else x for x in state], None))
        self.at = max(start, stop)
        return iter(rows)  # what Spark ships must be a list's iterator

    def __getstate__(self) -> dict:
        return self.__dict__ | {"live": None, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["step"] + self.per_batch
        return self._rows(start["step"], end), {"step": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["step"], end["step"])

    def commit(self, end: dict) -> None:
        pass


def register_sources(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FrameSource)


__all__ = ["FrameSource", "generate", "generate_stream", "register_sources", "shard_batches"]
