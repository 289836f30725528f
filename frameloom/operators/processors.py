"""Processors: (frames, config) -> frames, each sample in the order of pos.

Stateful ones are window functions over one partitioning, so a chain of them costs one exchange. Arrays are never exploded.
With per_range in their config samples may be endless: they are split by ranges of pos, whatever their number (see ranged).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from frameloom.errors import InvalidParams, PipelineError
from frameloom.functions import frames as X
from frameloom.model import KEY, kind_of
from frameloom.operators import ranged
from frameloom.registry import Registry

Processor = Callable[[DataFrame, dict], DataFrame]
PROCESSORS: Registry[Processor] = Registry("processor")
#: Fixed value: the label of a separator frame.
SEPARATOR, BATCH = "__SEPARATOR__", "batch_data"


def whole_number(config: dict, name: str, least: int, default=None) -> int:
    value = config.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise InvalidParams(f"{name} must be a whole number of {least} or more, not {value!r}")
    return value


@PROCESSORS.named("null")
def identity(frames: DataFrame, config: dict) -> DataFrame:
    return frames


@PROCESSORS.named("normalizer")
def normalizer(frames: DataFrame, config: dict) -> DataFrame:
    """Float cells to whole numbers 0 .. max_val between the sample's smallest and largest cell, or between given bounds.

    With both bounds given no window is needed. Truth becomes 0 and 1, whole numbers stay.
    """
    kind, most, method = kind_of(frames), float(config.get("max_val", 255)), config.get("method", "Linear")
    if kind != "float":
        return frames if kind == "int" else frames.withColumn("state", X.cells_as_int(F.col("state"), kind))
    low, high = config.get("min"), config.get("max")
    if low is not None and high is not None:
        lo, hi = F.lit(float(low)), F.lit(float(high if high != low else low + 1))
        return frames.withColumn("state", F.transform("state", lambda v: X.scaled(v, lo, hi, most, method)))
    bounded = ranged.with_bounds(frames, F.array_min("state"), F.array_max("state"), ("_low", "_most"), config.get("per_range"))
    bounded = bounded.withColumn("_high", F.when(F.col("_most") == F.col("_low"), F.col("_low") + 1).otherwise(F.col("_most")))
    return bounded.withColumn("state", F.transform("state", lambda v: X.scaled(v, F.col("_low"), F.col("_high"), most, method))).drop("_low", "_most", "_high")


@PROCESSORS.named("dedup")
def dedup(frames: DataFrame, config: dict) -> DataFrame:
    """Frames that are all zero, poor in entropy, or equal to the last one kept go.

    The first two tests look at the frame alone, so the last frame kept is the one before among those that pass them.
    """
    kind, least = kind_of(frames), float(config.get("min_entropy", 0.0))
    if config.get("remove_all_zeros", True):
        frames = frames.where(~X.all_zero(F.col("state")))
    if least > 0:
        frames = frames.where(X.histogram_entropy(F.col("state"), kind) >= least)
    if config.get("remove_consecutive_duplicates", True):
        frames = ranged.with_before(frames, "_before", config.get("per_range")).where(~F.col("state").eqNullSafe(F.col("_before"))).drop("_before")
    return frames


@PROCESSORS.named("diff_encoder")
def diff_encoder(frames: DataFrame, config: dict) -> DataFrame:
    """Each frame less the one before it; the first as it is, with or without prepend_zero_frame."""
    told = ranged.with_before(frames, "_before", config.get("per_range"))
    return told.withColumn("state", F.when(F.col("_before").isNull(), F.col("state")).otherwise(X.difference(F.col("state"), F.col("_before"), kind_of(frames)))).drop("_before")


@PROCESSORS.named("token_mapper")
def token_mapper(frames: DataFrame, config: dict) -> DataFrame:
    start = whole_number(config, "start_codepoint", 0, 0x4E00)
    state = X.codepoints(F.col("state"), kind_of(frames), start)
    return frames.withColumn("state", F.array_append(state, F.lit(10).cast("bigint")) if config.get("insert_newline") else state)


@PROCESSORS.named("clip_stitcher")
def clip_stitcher(frames: DataFrame, config: dict) -> DataFrame:
    """After every max_len frames that others follow, an empty frame whose step is its ordinal; max_len 0 keeps nothing.

    Each frame that a separator follows gives two rows, so one window and no second read of the frames are enough.
    """
    if config.get("max_len") == 0:
        return frames.limit(0)
    if not config.get("insert_separator") or config.get("max_len") is None:
        return frames
    n = whole_number(config, "max_len", 1)
    ordered = ranged.with_more(ranged.numbered(frames, "_n", config.get("per_range")), "_more", config.get("per_range")).withColumn("_n", F.col("_n") + 1)
    copies = ordered.withColumn("_sep", F.explode(F.when((F.col("_n") % n == 0) & F.col("_more"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    gone = F.floor((F.col("_n") - 1) / n)  # separators ahead of this frame
    kind = frames.schema["state"].dataType
    return copies.select(
        *KEY, (F.col("_n") - 1 + gone + F.col("_sep").cast("int")).cast("bigint").alias("pos"), F.when(F.col("_sep"), gone.cast("bigint")).otherwise(F.col("step_index")).alias("step_index"),
        F.when(F.col("_sep"), F.array().cast(kind)).otherwise(F.col("state")).alias("state"), F.when(F.col("_sep"), F.lit(SEPARATOR)).otherwise(F.col("label")).alias("label"),
    )


@PROCESSORS.named("patch_tokenizer")
def patch_tokenizer(frames: DataFrame, config: dict) -> DataFrame:
    p, rows, cols = (whole_number(config, n, 1) for n in ("patch", "rows", "cols"))
    state = X.cells_as_int(F.col("state"), kind_of(frames))
    return frames.withColumn("state", X.patch_tokens(state, p, rows, cols, whole_number(config, "num_colors", 2, 10), whole_number(config, "n_groups", 1, 1), config.get("stride")))


def _chunks(frames: DataFrame, size: int, per_range: int | None) -> DataFrame:
    """Runs of `size` frames, each as one row with the arrays in order: groups are bounded by size."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "state")))
    first = F.min(F.struct("pos", "step_index", "label"))
    told = ranged.numbered(frames, "_n", per_range).withColumn("_chunk", F.floor(F.col("_n") / size).cast("bigint"))
    return told.groupBy(*KEY, "_chunk").agg(F.flatten(F.transform(parts, lambda x: x["state"])).alias("state"), first.alias("_first"))


@PROCESSORS.named("sequence_stitcher")
def sequence_stitcher(frames: DataFrame, config: dict) -> DataFrame:
    """Every frames_per_sequence frames as one, with start and end tokens if wanted; a shorter rest is kept."""
    made = _chunks(frames, whole_number(config, "frames_per_sequence", 1), config.get("per_range"))
    state = F.col("state")
    for flag, name in (("add_start_token", "start_token"), ("add_end_token", "end_token")):
        if config.get(flag):
            token = F.array(F.lit(whole_number(config, name, -(1 << 63))).cast("bigint"))
            state = F.concat(token, state) if name == "start_token" else F.concat(state, token)
    return made.select(*KEY, F.col("_chunk").alias("pos"), F.col("_first.step_index").alias("step_index"), state.alias("state"), F.col("_first.label").alias("label"))


@PROCESSORS.named("batch_collector")
def batch_collector(frames: DataFrame, config: dict) -> DataFrame:
    """Every batch_size * num_frames frames as one flat frame of step 0; a shorter rest is kept."""
    made = _chunks(frames, whole_number(config, "batch_size", 1) * whole_number(config, "num_frames", 1), config.get("per_range"))
    return made.select(*KEY, F.col("_chunk").alias("pos"), F.lit(0).cast("bigint").alias("step_index"), "state", F.lit(BATCH).alias("label"))


#: Processors after which rows are gone, so that pos has gaps.
DROPPING = {"dedup"}


def rewritten(steps: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """The chain without steps that change nothing."""
    idle = lambda name, c: name == "null" or name == "clip_stitcher" and not c.get("insert_separator") and c.get("max_len") != 0
    return [(name, c) for name, c in steps if not idle(name, c)]


def chain(frames: DataFrame, steps: list[tuple[str, dict]], per_range: int | None = None) -> DataFrame:
    """The processors one after another; pos is counted anew at the end only if rows went.

    per_range, for frames with samples of many millions of frames, goes to every step that has none of its own.
    """
    missing = [c for c in (*KEY, "pos", "step_index", "state", "label") if c not in frames.columns]
    if missing:
        raise PipelineError(f"frames lack {', '.join(missing)}")
    shared = {} if per_range is None else {"per_range": per_range}
    steps = rewritten([(name, shared | (config or {})) for name, config in steps])
    out = reduce(lambda df, step: PROCESSORS.get(step[0])(df, step[1]), steps, frames)
    if not any(name in DROPPING for name, _ in steps):
        return out
    return ranged.numbered(out, "_n", per_range).withColumn("pos", F.col("_n")).drop("_n")
