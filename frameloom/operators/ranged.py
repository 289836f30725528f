"""What a processor asks of the frames around it: the frame before, a frame's number, bounds of its sample.

By sample these are windows. With `per_range` a sample is split by ranges of so many places of pos, so that one endless sample
spreads over as many tasks as it has ranges: windows run within a range, and what a range needs of those before it is a row for
each range (its last frame, its number of frames, its smallest and largest cell), joined back. Both ways give the same rows.

Frames are read twice for that, so they are written into the shared folder first: a chain costs as many writes as it has such steps,
and no step runs those before it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameloom.errors import InvalidParams
from frameloom.lineage import broadcast_if_few, checkpointed
from frameloom.model import KEY, sample_window


def split(frames: DataFrame, per_range: int) -> DataFrame:
    """frames with the range that their pos falls in."""
    if isinstance(per_range, bool) or not isinstance(per_range, int) or per_range < 1:
        raise InvalidParams(f"per_range must be a whole number of 1 or more, not {per_range!r}")
    return frames.withColumn("_range", F.floor(F.col("pos") / per_range).cast("bigint"))


def _within() -> Window:
    return Window.partitionBy(*KEY, "_range").orderBy("pos")


def _ranges_ahead() -> Window:
    """The ranges of a sample, in order: a row for each."""
    return Window.partitionBy(*KEY).orderBy("_range")


def _with_ranges(split_: DataFrame, told: DataFrame, *keys: str) -> DataFrame:
    """split_ with the columns of told, which has a row for each sample or range: broadcast where these are few, else shuffled."""
    other = told.select(*[F.col(k).alias(f"_{k}_of") for k in keys], *[c for c in told.columns if c not in keys])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    return split_.join(broadcast_if_few(checkpointed(other)), met, "left").drop(*[f"_{k}_of" for k in keys])


def with_before(frames: DataFrame, name: str = "before", per_range: int | None = None) -> DataFrame:
    """frames with the state of the frame before in its sample; null for the first."""
    if per_range is None:
        return frames.withColumn(name, F.lag("state").over(sample_window()))
    told = checkpointed(split(frames, per_range))
    last = told.groupBy(*KEY, "_range").agg(F.max_by("state", "pos").alias("_last"))
    edges = last.select(*KEY, "_range", F.lag("_last").over(_ranges_ahead()).alias("_edge")).where("_edge is not null")
    inner = told.withColumn(name, F.lag("state").over(_within())).withColumn("_first", F.row_number().over(_within()) == 1)
    other = edges.select(*[F.col(k).alias(f"_{k}_of") for k in (*KEY, "_range")], "_edge")  # holds states, so it is never broadcast unasked
    met = F.col("_first")
    for k in (*KEY, "_range"):
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    out = inner.join(other, met, "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(name))).select(*frames.columns, name)


def numbered(frames: DataFrame, name: str, per_range: int | None = None) -> DataFrame:
    """frames with their number in their sample, from 0, in the order of pos."""
    if per_range is None:
        return frames.withColumn(name, F.row_number().over(sample_window()) - F.lit(1).cast("bigint"))
    told = checkpointed(split(frames, per_range))
    counts = told.groupBy(*KEY, "_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(_ranges_ahead().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _with_ranges(told, counts.select(*KEY, "_range", ahead.cast("bigint").alias("_ahead")), *KEY, "_range")
    return out.withColumn(name, F.row_number().over(_within()) - 1 + F.col("_ahead")).select(*frames.columns, name)


def with_more(frames: DataFrame, name: str, per_range: int | None = None) -> DataFrame:
    """frames with whether another one follows in their sample."""
    if per_range is None:
        return frames.withColumn(name, F.lead("pos").over(sample_window()).isNotNull())
    frames = checkpointed(frames)
    last = frames.groupBy(*KEY).agg(F.max("pos").alias("_last"))
    return _with_ranges(frames, last, *KEY).withColumn(name, F.col("pos") < F.col("_last")).select(*frames.columns, name)


def with_bounds(frames: DataFrame, low: Column, high: Column, names: tuple[str, str], per_range: int | None = None) -> DataFrame:
    """frames with the smallest `low` and the largest `high` of their sample."""
    if per_range is None:
        sample = Window.partitionBy(*KEY)
        return frames.withColumn(names[0], F.min(low).over(sample)).withColumn(names[1], F.max(high).over(sample))
    frames = checkpointed(frames)
    bounds = frames.groupBy(*KEY).agg(F.min(low).alias(names[0]), F.max(high).alias(names[1]))
    return _with_ranges(frames, bounds, *KEY).select(*frames.columns, *names)
