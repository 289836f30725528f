"""Statistics of frames and runs."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from frameloom.errors import InvalidParams
from frameloom.functions import frames as X
from frameloom.lineage import broadcast_if_few, checkpointed
from frameloom.model import KEY, sample_window


def density(frames: DataFrame, by: list[str]) -> DataFrame:
    """The share of cells above 0."""
    filled = F.sum(F.size(F.filter("state", lambda v: v.cast("double") > 0)))
    return frames.groupBy(*by).agg((filled / F.sum(F.size("state"))).alias("density"))


def with_before(frames: DataFrame) -> DataFrame:
    return frames.withColumn("before", F.lag("state").over(sample_window()))


def change_rate(frames: DataFrame) -> DataFrame:
    """By sample: changed cells over compared cells of frames that follow each other; 0 without any."""
    n = F.when(F.col("before").isNotNull(), F.least(F.size("state"), F.size("before")))
    told = with_before(frames).withColumn("n", n)
    changed = F.sum(F.when(F.col("n").isNotNull(), F.col("n") * X.changed_share(F.col("state"), F.col("before"))))
    return told.groupBy(*KEY).agg(F.coalesce(changed / F.sum("n"), F.lit(0.0)).alias("change_rate"))


def rule_score(frames: DataFrame) -> DataFrame:
    """By sample: the mean share of changed cells from the third frame on."""
    told = with_before(frames).where("pos >= 2")
    return told.groupBy(*KEY).agg(F.avg(X.changed_share(F.col("state"), F.col("before"))).alias("score"))


def in_band(scores: DataFrame, low: float, high: float, wanted: int | None = None) -> DataFrame:
    """Rules whose score lies strictly between the bounds, as many as wanted by sample order."""
    kept = scores.where((F.col("score") > low) & (F.col("score") < high))
    return kept if wanted is None else kept.orderBy(*KEY).limit(wanted)


def final_states(frames: DataFrame, *by: str) -> DataFrame:
    return frames.groupBy(*KEY, *by).agg(F.max_by("state", "pos").alias("state"))


def pattern_diversity(frames: DataFrame, by: list[str]) -> DataFrame:
    """Distinct last frames, and their share of the samples."""
    return final_states(frames, *by).groupBy(*by).agg(F.count_distinct("state").alias("patterns"), (F.count_distinct("state") / F.count(F.lit(1))).alias("diversity"))


def state_sketches(frames: DataFrame, by: list[str], lg: int = 12) -> DataFrame:
    """(by..., shard_id, samples, sketch): a mergeable sketch of the last frames of each shard's samples.

    Only hashes of states are moved; sketches have a fixed size, can be stored, and those of new shards join them later.
    """
    last = frames.groupBy(*KEY, *by).agg(F.max_by(F.xxhash64("state"), "pos").alias("h"))
    return last.groupBy(*by, "shard_id").agg(F.count(F.lit(1)).alias("samples"), F.hll_sketch_agg("h", lg).alias("sketch"))


def sketched_diversity(sketches: DataFrame, by: list[str]) -> DataFrame:
    """About how many distinct last frames, and their share of the samples; the standard error is 1.04 / sqrt(2**lg) of them."""
    united = sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("patterns"), F.sum("samples").alias("samples"))
    return united.select(*by, "patterns", (F.col("patterns") / F.col("samples")).alias("diversity"))


@F.pandas_udf(T.DoubleType())
def compressed_share(data: pd.Series) -> pd.Series:
    """The size of the compressed bytes over that of the bytes; 0 for none."""
    return data.map(lambda b: len(gzip.compress(bytes(b), 9, mtime=0)) / len(b) if b else 0.0).astype(float)


def rollup(values: DataFrame, sample: list[str], by: list[str], value: str) -> DataFrame:
    """Means of samples first, then their mean and population deviation."""
    means = values.groupBy(*by, *sample).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


#: Bodies of a system in a block of pairs, about.
BODIES = 1024


def pairwise(rows: DataFrame, system: list[str], body: str, per_block: int = BODIES) -> DataFrame:
    """Ordered pairs (a, b) of different rows of a system, under the aliases a and b: the work is quadratic in a system by definition.

    A system of more than per_block bodies becomes a grid of blocks: a body goes to one row of the grid as a and to one column as
    b, so its system's pairs spread over as many tasks as the grid has fields, and each field holds about per_block ** 2 pairs.
    """
    names = [f"_s{i}" for i in range(len(system))]
    large = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(system, names, strict=True)]).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_grid")).where("_grid > 1")
    large = checkpointed(large)
    of = F.lit(True)
    for c, n in zip(system, names, strict=True):
        of = of & (F.col(c) == F.col(n))
    dealt = rows.join(broadcast_if_few(large), of, "left").drop(*names).withColumn("_grid", F.coalesce("_grid", F.lit(1)))
    own, every = F.pmod(F.xxhash64(body), "_grid").cast("int"), F.explode(F.sequence(F.lit(0), F.col("_grid") - 1))
    left, right = dealt.withColumn("_row", own).withColumn("_column", every), dealt.withColumn("_column", own).withColumn("_row", every)
    same = (F.col("a._row") == F.col("b._row")) & (F.col("a._column") == F.col("b._column"))
    for c in system:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return left.alias("a").join(right.alias("b"), same & (F.col(f"a.{body}") != F.col(f"b.{body}")))


def compared(values: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """Each row against a reference of one row: difference, and ratio (infinite where the reference is 0)."""
    ref = reference.select(F.col(name).alias("reference"))
    ratio = F.when(F.col("reference") == 0, F.lit(float("inf"))).otherwise(F.col(name) / F.col("reference"))
    return values.crossJoin(F.broadcast(ref)).withColumn("difference", F.abs(F.col(name) - F.col("reference"))).withColumn("ratio", ratio)


def grid_accuracy(pairs: DataFrame, by: list[str], predicted: str = "predicted", target: str = "target") -> DataFrame:
    """The share of cells that agree, and of grids that agree everywhere."""
    agree = F.size(F.filter(F.zip_with(predicted, target, lambda a, b: a.eqNullSafe(b)), lambda s: s))
    n = F.size(target)
    return pairs.groupBy(*by).agg((F.sum(agree) / F.sum(n)).alias("cell_accuracy"), F.avg((agree == n).cast("double")).alias("grid_accuracy"))


def run_rollup(shards: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Shard results (task, shard_id, samples, frames, bytes, error) by task, and a last row of totals with a null task."""
    ok = F.col("error").isNull()
    add = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(f"total_{c}")
    if tasks is not None:
        shards = F.broadcast(tasks.select("task")).join(shards, "task", "left")
    rows = shards.rollup("task").agg(F.count("shard_id").alias("shard_count"), add("samples"), add("frames"), add("bytes"), F.count_if(F.col("error").isNotNull()).alias("failed_shards"))
    return rows.withColumn("frames_per_sample", F.when(F.col("total_samples") > 0, F.col("total_frames") / F.col("total_samples")).otherwise(F.lit(0.0)))


def chance_normalised(answers: DataFrame, by: str, correct: str, choices: str) -> DataFrame:
    """By category: max(0, (mean - 1/c) / (1 - 1/c)); the macro average is its mean over categories."""
    means = answers.groupBy(by).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.max(choices).alias("choices"))
    chance = 1 / F.col("choices")
    return means.withColumn("normalised", F.greatest(F.lit(0.0), (F.col("accuracy") - chance) / (1 - chance)))


def curve_stats(points: DataFrame, curve: str, step: str, value: str, edge: int = 5) -> DataFrame:
    """By curve: first, last, smallest value and where, means of the first and last five, and the drop in per cent."""
    place, all_ = Window.partitionBy(curve).orderBy(step), Window.partitionBy(curve)
    told = points.withColumn("_a", F.row_number().over(place)).withColumn("_z", F.count(F.lit(1)).over(all_) + 1 - F.col("_a"))
    mean = lambda c: F.avg(F.when(F.col(c) <= edge, F.col(value)))
    out = told.groupBy(curve).agg(F.min_by(value, "_a").alias("first_value"), F.min_by(value, "_z").alias("last_value"), F.min(value).alias("least"), F.min_by(F.col("_a") - 1, F.struct(value, "_a")).alias("least_at"), mean("_a").alias("first_mean"), mean("_z").alias("last_mean"))
    return out.withColumn("drop_percent", F.when(F.col("first_value") != 0, (F.col("first_value") - F.col("last_value")) / F.col("first_value") * 100))


def subsampled(frames: DataFrame, start: int, stride: int) -> DataFrame:
    """Every stride-th frame from start on."""
    return frames.where((F.col("pos") >= start) & ((F.col("pos") - start) % stride == 0))


def rollout(frames: DataFrame, steps: int, sampling: str = "video", start: int = 0, stride: int = 1, with_first: bool = False) -> DataFrame:
    """What a simulation shows: every stride-th of `steps` frames from start on, or the one after `steps` steps, with the first if wanted."""
    if sampling == "video":
        return subsampled(frames, start, stride).where(F.col("pos") < start + steps)
    if sampling != "final":
        raise InvalidParams(f"sampling is video or final, not {sampling!r}")
    return frames.where(F.col("pos").isin([0, steps] if with_first else [steps]))


def masked_sum(rows: DataFrame, by: list[str], value: Column, counted: Column, name: str) -> DataFrame:
    """The sum of a value over the rows that a mask leaves in, such as a sequence's log-probability."""
    return rows.groupBy(*by).agg(F.sum(F.when(counted, value)).alias(name))


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """Per cent, rate and time left."""
    rate = F.when(seconds > 0, done / seconds)
    return {"percent": F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0)), "rate": rate, "eta": F.when(rate > 0, X.clock(F.greatest(total - done, F.lit(0)) / rate))}


def bracket_metrics(rows: DataFrame, conditional, symbols: int, max_depth: int) -> DataFrame:
    """(token_accuracy, conditional_validity) over rows of (sequence, target, prediction); conditional says how many predictions fit."""
    per = rows.select(X.equal_places(F.col("target"), F.col("prediction")).alias("equal"), conditional(F.col("sequence"), F.col("prediction"), symbols, max_depth).alias("valid"), F.size("sequence").alias("n"))
    return per.agg(F.round(F.sum("equal") / F.sum("n"), 6).alias("token_accuracy"), F.round(F.sum("valid") / F.sum("n"), 6).alias("conditional_validity"))
