"""Processors over endless frames: what a batch does with a window is keyed state here.

Processors run on transformWithState: samples share lanes, and a lane's map state has an entry for each of its samples, with an expiry
where a sample may end without notice, and timers that hand out what waits. A micro-batch reads and writes the entries of the
samples that it has. Frames of a sample must arrive in the order of pos; those of one micro-batch are sorted. An entry is one frame,
the rest of a chunk or the last n frames, so it stays small however long a sample runs, and a query that starts again from its
checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from frameloom.errors import InvalidParams
from frameloom.model import KEY, KINDS, kind_of, schema
from frameloom.operators.corpus import dense_positions
from frameloom.workers import ship

#: The store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for a null sample while it is a key.
UNNAMED = -(1 << 63)

#: Lanes that samples share: a call of a processor costs some milliseconds, however few rows it has. A checkpoint is bound to them.
LANES = 2048
LANE = "lane_of_samples"


def ready(spark: SparkSession) -> None:
    """Workers find this package, and keyed state has the store that it needs."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _plain(cells) -> list:
    """Cells as Python values: state does not hold NumPy's."""
    return cells.tolist() if hasattr(cells, "tolist") else list(cells)


class FrameProcessor(StatefulProcessor):
    """Frames of a lane's samples, by sample and sorted, batch by batch; `expiry` is how long (ms) a sample's state outlives its last
    frame, None for ever. State is a map from a sample to what is kept of it, `kept` its schema."""

    def __init__(self, kind: str, expiry: int | None = None):
        self.kind, self.cells, self.expiry = kind, f"array<{KINDS[kind]}>", expiry

    @property
    def kept(self) -> str:
        return f"cells {self.cells}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "task string, shard_id int, sample_id bigint", self.kept, self.expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = pd.concat(list(rows), ignore_index=True)
        number = made.groupby(list(KEY), dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((made["pos"], number))
        made, cuts = made.iloc[order], (np.flatnonzero(np.diff(number[order])) + 1).tolist()
        starts = [0, *cuts]
        samples = zip(*[[None if pd.isna(v) else kind(v) for v in made[c].iloc[starts]] for c, kind in zip(KEY, (str, int, int), strict=True)], strict=True)
        yield self.frames(made.drop(columns=LANE, errors="ignore"), list(zip(samples, starts, [*cuts, len(made)], strict=True)), timerValues)

    def frames(self, made: pd.DataFrame, spans: list[tuple], timers) -> pd.DataFrame:
        """What the sorted frames give; spans are (sample, first row, row after its last)."""
        raise NotImplementedError


class Dedup(FrameProcessor):
    """Frames that are not all zero and differ from the last one kept, which is the state."""

    def __init__(self, kind: str, remove_all_zeros: bool, expiry: int | None):
        super().__init__(kind, expiry)
        self.remove_all_zeros = remove_all_zeros

    def frames(self, made, spans, timers):
        keep, states = np.zeros(len(made), bool), list(map(_plain, made["state"]))
        for sample, i, j in spans:
            last = _plain(held[0]) if (held := self.held.getValue(sample)) else None
            for k in range(i, j):
                if states[k] != last and not (self.remove_all_zeros and not any(states[k])):
                    keep[k], last = True, states[k]
            if keep[i:j].any():
                self.held.updateValue(sample, (last,))
        return made[keep]


class Difference(FrameProcessor):
    """Each frame less the one before it, which is the state."""

    def frames(self, made, spans, timers):
        out, states, truth = [], list(map(_plain, made["state"])), self.kind == "bool"
        for sample, i, j in spans:
            before = _plain(held[0]) if (held := self.held.getValue(sample)) else None
            for cells in states[i:j]:
                out.append(cells if before is None else [a != b if truth else a - b for a, b in zip(cells, before, strict=False)])
                before = cells
            self.held.updateValue(sample, (before,))
        return made.assign(state=out)


class Stitch(FrameProcessor):
    """Every so many frames as one. What waits is an array of frames; with `idle` a timer (processing time) hands a shorter rest out.
    Timers are those of a lane, so that with `idle` each sample is a lane of its own."""

    def __init__(self, kind: str, per: int, idle: int | None):
        super().__init__(kind)
        self.per, self.idle = per, idle

    @property
    def kept(self) -> str:
        return f"n bigint, timer bigint, waiting array<struct<step: bigint, cells: {self.cells}>>"

    def joined(self, sample, n: int, frames: list[tuple]) -> tuple:
        return (*sample, n, frames[0][0], [c for _, cells in frames for c in cells], None)

    def frames(self, made, spans, timers):
        out, steps, states = [], made["step_index"].tolist(), list(map(_plain, made["state"]))
        for sample, i, j in spans:
            n, timer, waiting = self.held.getValue(sample) or (0, -1, [])
            waiting = [(step, _plain(cells)) for step, cells in waiting] + list(zip(steps[i:j], states[i:j], strict=True))
            full = len(waiting) // self.per
            out += [self.joined(sample, n + k, waiting[k * self.per : (k + 1) * self.per]) for k in range(full)]
            n, waiting = n + full, waiting[full * self.per :]
            if self.idle is not None:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                timer = timers.getCurrentProcessingTimeInMs() + self.idle if waiting else -1
                if waiting:
                    self.handle.registerTimer(timer)
            self.held.updateValue(sample, (n, timer, waiting))
        return pd.DataFrame(out, columns=list(made.columns)) if out else made.iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for sample, (n, _, waiting) in list(self.held.iterator()):
            self.held.updateValue(sample, (n + 1, -1, []))
            if waiting:
                yield pd.DataFrame([self.joined(sample, n, [(step, _plain(cells)) for step, cells in waiting])], columns=[*KEY, "pos", "step_index", "state", "label"])


class Retain(FrameProcessor):
    """The last n frames of a sample, the oldest first, and how many there have been."""

    def __init__(self, kind: str, n: int, expiry: int | None):
        super().__init__(kind, expiry)
        self.n = n

    @property
    def kept(self) -> str:
        return f"seen bigint, ring array<struct<pos: bigint, step: bigint, cells: {self.cells}, label: string>>"

    def frames(self, made, spans, timers):
        out, states = [], made["state"].to_numpy()
        pos, steps, labels = made["pos"].tolist(), made["step_index"].tolist(), made["label"].tolist()
        for sample, i, j in spans:
            seen, ring = self.held.getValue(sample) or (0, [])
            ring = [(p, step, _plain(cells), label) for p, step, cells, label in ring]
            ring = (ring + [(pos[k], steps[k], _plain(states[k]), labels[k]) for k in range(max(i, j - self.n), j)])[-self.n :]
            seen += j - i
            self.held.updateValue(sample, (seen, ring))
            base = seen - len(ring)
            out += [(*sample, *frame, base, place) for place, frame in enumerate(ring)]
        return pd.DataFrame(out, columns=[*KEY, "pos", "step_index", "state", "label", "base", "place"])


class Fill(StatefulProcessor):
    """Rows of a group fill buffers of a budget: a buffer goes out once its sizes reach it. What waits is a list of (item, size)."""

    def __init__(self, key: str, budget: int):
        self.key, self.budget = key, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "item bigint, size bigint")
        self.made = handle.getValueState("made", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        made = pd.concat(list(rows)).sort_values("item", kind="stable")
        held, out = [(int(i), int(s)) for i, s in self.waiting.get()], []
        n, total = self.made.get()[0] if self.made.exists() else 0, sum(s for _, s in held)
        for item, size in zip(made["item"], made["size"], strict=True):
            held.append((int(item), int(size)))
            total += int(size)
            if total >= self.budget:
                out.append((key[0], n, [i for i, _ in held], total))
                held, total, n = [], 0, n + 1
        self.waiting.put(held) if held else self.waiting.clear()
        self.made.update((n,))
        yield pd.DataFrame(out, columns=[self.key, "buffer", "items", "total"])


def _grouped(frames: DataFrame, processor: FrameProcessor, extra: str = "", mode: str = "append", timed: bool = False, alone: bool = False) -> DataFrame:
    """Samples go to LANES lanes by a digest, and a processor is called once a lane and micro-batch, or once a sample if they are to be
    `alone`. A timed stream, one with an expiry or with timers, has batches for its clock alone and never ends by itself: it wants a
    trigger of its own, not run_through."""
    ready(frames.sparkSession)
    timed = timed or processor.expiry is not None
    known = frames.withColumn("sample_id", F.coalesce("sample_id", F.lit(UNNAMED)))  # workers do not see that two nulls are one key
    dealt = known.groupBy(*KEY) if alone else known.withColumn(LANE, F.pmod(F.xxhash64(*KEY), F.lit(LANES)).cast("int")).groupBy(LANE)
    made = dealt.transformWithStateInPandas(processor, schema(processor.kind) + extra, mode, "ProcessingTime" if timed else "None")
    return made.withColumn("sample_id", F.when(F.col("sample_id") != UNNAMED, F.col("sample_id")))


def stream_dedup(frames: DataFrame, remove_all_zeros: bool = True, expiry: int | None = None) -> DataFrame:
    """Frames that are not all zero and differ from the last one kept."""
    return _grouped(frames, Dedup(kind_of(frames), remove_all_zeros, expiry))


def stream_diff(frames: DataFrame, expiry: int | None = None) -> DataFrame:
    """Each frame less the one before it; the first, and the first after an expiry, as it is."""
    return _grouped(frames, Difference(kind_of(frames), expiry))


def stream_stitch(frames: DataFrame, frames_per_sequence: int, idle: int | None = None) -> DataFrame:
    """Every so many frames as one; a shorter rest waits, or goes out once its sample has been idle for so many milliseconds."""
    if frames_per_sequence < 1:
        raise InvalidParams("frames_per_sequence must be 1 or more")
    return _grouped(frames, Stitch(kind_of(frames), frames_per_sequence, idle), timed=idle is not None, alone=idle is not None)


def stream_last(frames: DataFrame, n: int, expiry: int | None = None) -> DataFrame:
    """After each micro-batch the last n frames of the samples that it has touched: base is the number of frames evicted so far,
    place a frame's number less base. A retention buffer, to be written in update mode."""
    if n < 1:
        raise InvalidParams("a buffer holds one frame or more")
    return _grouped(frames, Retain(kind_of(frames), n, expiry), ", base bigint, place bigint", "update")


def stream_fill(rows: DataFrame, group: str, item: str, size: str, budget: int) -> DataFrame:
    """(group, buffer, items, total): whole items, a group's in order, fill a buffer until their sizes reach the budget. Rows without
    a group are left out."""
    ready(rows.sparkSession)
    kind = rows.schema[group].dataType.simpleString()
    told = rows.where(F.col(group).isNotNull()).select(group, F.col(item).cast("bigint").alias("item"), F.col(size).cast("bigint").alias("size"))
    return told.groupBy(group).transformWithStateInPandas(Fill(group, budget), f"{group} {kind}, buffer bigint, items array<bigint>, total bigint", "append", "None")


def last_frames(frames: DataFrame, n: int) -> DataFrame:
    """The last n frames of each sample of a bounded table, with their places from the oldest kept; a retention buffer."""
    newest = Window.partitionBy(*KEY).orderBy(F.col("pos").desc())
    kept = frames.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    return kept.withColumn("place", (size - F.col("_back")).cast("bigint")).drop("_back")


def replay_files(rows: DataFrame, order: str, per_batch: int, folder: str) -> None:
    """Write rows, in the order of a distinct whole-numbered column, as a file for each per_batch of them, dated in that order."""
    if per_batch < 1:
        raise InvalidParams("a batch has one row or more")
    spark = rows.sparkSession
    placed = dense_positions(rows, order, name="_at").withColumn("_batch", F.floor(F.col("_at") / per_batch).cast("bigint")).drop("_at")
    placed.repartition("_batch").sortWithinPartitions("_batch", order).write.partitionBy("_batch").parquet(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [p for p in store.listStatus(where) if p.isDirectory()]
    for part in parts:  # a file for each batch
        number = int(part.getPath().getName().rpartition("=")[2])
        for file in store.listStatus(part.getPath()):
            store.setTimes(file.getPath(), 1_000_000_000_000 + 1000 * number, -1)


def replayed(spark: SparkSession, folder: str, batches: int = 1) -> DataFrame:
    """What replay_files has written as a stream, so many of its batches at a time: the oldest first, read by the executors."""
    columns = spark.read.parquet(folder).drop("_batch").schema
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", batches).option("recursiveFileLookup", "true").parquet(folder)


def run_through(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into Parquet files, batch by batch, and end; in update mode with the batch's number."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", folder).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("_epoch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/epoch={n}")).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling or sliding time windows, late ones up to the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
