"""How far a running job is, from Spark itself: the tasks of its stages, and what a stream says of its micro-batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class State:
    """Tasks done and known so far, per cent, tasks a second, and seconds left (None before any task is done)."""

    done: int = 0
    total: int = 0
    seconds: float = 0.0

    @property
    def percent(self) -> float:
        return 100.0 * self.done / self.total if self.total else 0.0

    @property
    def rate(self) -> float:
        return self.done / self.seconds if self.seconds > 0 else 0.0

    @property
    def left(self) -> float | None:
        return (self.total - self.done) / self.rate if self.rate else None

    def line(self) -> str:
        clock = "--:--:--" if self.left is None else f"{int(self.left) // 3600:02d}:{int(self.left) // 60 % 60:02d}:{int(self.left) % 60:02d}"
        return f"{self.percent:5.1f} % of {self.total} tasks, {self.rate:.1f} a second, {clock} left"


@contextmanager
def watching(spark: SparkSession, tell: Callable[[State], None], every: float = 0.5) -> Iterator[None]:
    """Tell how far the jobs that this thread starts within are, every so many seconds and at the end."""
    sc, group = spark.sparkContext, f"frameloom-{uuid4().hex}"
    before = {name: sc.getLocalProperty(name) for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    tracker, over, began, stages = sc.statusTracker(), threading.Event(), time.monotonic(), {}

    def look() -> State:
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                now = tracker.getStageInfo(stage)
                if now and info.status == "SUCCEEDED":  # what it had to do is done: the rest was skipped
                    stages[stage] = (now.numCompletedTasks, now.numCompletedTasks)
                elif now:
                    stages[stage] = (now.numCompletedTasks, now.numTasks)
        return State(sum(d for d, _ in stages.values()), sum(n for _, n in stages.values()), time.monotonic() - began)

    def run() -> None:
        while not over.wait(every):
            tell(look())

    sc.setJobGroup(group, before["spark.job.description"] or "frameloom")
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        for name, value in before.items():
            sc.setLocalProperty(name, value)
        tell(look())


def observed(frames: DataFrame, **more: Column) -> tuple[DataFrame, Observation]:
    """frames that count themselves while they are written: frames, cells and what else is asked for, without another job."""
    told = Observation(f"frames-{uuid4().hex}")
    return frames.observe(told, F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum(F.size("state")), F.lit(0)).alias("cells"), *[c.alias(n) for n, c in more.items()]), told


@dataclass
class Told:
    """What the micro-batches of a query have read so far, and its last rate."""

    batches: int = 0
    rows: int = 0
    rate: float = 0.0
    error: str | None = None
    over: bool = False


@dataclass
class StreamProgress(StreamingQueryListener):
    """Batches and rows of each query by its name or run, kept up by Spark: `spark.streams.addListener(StreamProgress())`."""

    tell: Callable[[str, Told], None] | None = None
    queries: dict[str, Told] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        name = event.name or str(event.runId)
        self.names[str(event.runId)] = name
        self.queries[name] = Told()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = self.names.get(str(p.runId), p.name or str(p.runId))
        told = self.queries.setdefault(name, Told())
        told.batches, told.rows, told.rate = told.batches + (p.numInputRows > 0), told.rows + p.numInputRows, p.processedRowsPerSecond
        if self.tell:
            self.tell(name, told)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        told = self.queries.setdefault(self.names.get(str(event.runId), str(event.runId)), Told())
        told.over, told.error = True, event.exception
