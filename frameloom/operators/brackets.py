"""Brackets of sequences with a row for each token, however long: validity by an associative reduction.

A stretch of brackets, once its own pairs are cancelled, is closings followed by openings. Two stretches that follow each other
combine by cancelling the first one's openings against the second one's closings, and combining is associative; so ranges of a
sequence are folded where they lie, and ranges are combined in a tree. What travels is what is still open, not the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from frameloom.functions.frames import let
from frameloom.lineage import checkpointed

#: Tokens in a range, and stretches combined at a time.
RANGE, FAN = 1024, 16
_NONE = "array<bigint>"


def _stretch(closes: Column, opens: Column, ok: Column) -> Column:
    return F.struct(closes.alias("closes"), opens.alias("opens"), ok.alias("ok"))


def nested_fold(tokens: Column, symbols: int) -> Column:
    """The stretch of an array of tokens: 0 .. symbols-1 open, the same plus symbols close, others never fit."""

    def step(acc: Column, v: Column) -> Column:
        depth = F.size(acc["opens"])
        opens, closes = (v >= 0) & (v < symbols), (v >= symbols) & (v < 2 * symbols)
        fits = F.coalesce(F.try_element_at(acc["opens"], F.lit(-1)) + symbols == v, F.lit(False))
        one = F.array(v.cast("bigint"))
        return _stretch(
            F.when(closes & (depth == 0), F.concat(acc["closes"], one)).otherwise(acc["closes"]),
            F.when(opens, F.concat(acc["opens"], one)).when(depth > 0, F.slice(acc["opens"], F.lit(1), depth - 1)).otherwise(acc["opens"]),
            acc["ok"] & F.coalesce(opens | (closes & ((depth == 0) | fits)), F.lit(False)),
        )

    empty = F.array().cast(_NONE)
    return F.aggregate(tokens, _stretch(empty, empty, F.lit(True)), step)


def nested_join(symbols: int) -> Callable[[Column, Column], Column]:
    def join(a: Column, b: Column) -> Column:
        n = F.least(F.size(a["opens"]), F.size(b["closes"]))
        held = F.size(a["opens"]) - n
        inner = F.reverse(F.slice(a["opens"], held + 1, n))
        fit = F.transform(inner, lambda v: v + symbols) == F.slice(b["closes"], F.lit(1), n)
        return _stretch(F.concat(a["closes"], F.slice(b["closes"], n + 1, F.size(b["closes"]) - n)), F.concat(F.slice(a["opens"], F.lit(1), held), b["opens"]), a["ok"] & b["ok"] & fit)

    return join


def counted_fold(tokens: Column, symbols: int) -> Column:
    """For each symbol on its own: what its brackets sum up to, and the least that they sum up to on the way; other tokens count nothing."""

    def step(acc: Column, v: Column) -> Column:
        total = F.transform(acc["total"], lambda n, i: n + F.when(v == i, 1).when(v == i + symbols, -1).otherwise(0))
        return let(total, lambda t: F.struct(t.alias("total"), F.zip_with(acc["least"], t, lambda x, y: F.least(x, y)).alias("least")))

    zeros = F.array_repeat(F.lit(0).cast("bigint"), symbols)
    return F.aggregate(tokens, F.struct(zeros.alias("total"), zeros.alias("least")), step)


def counted_join(a: Column, b: Column) -> Column:
    after = F.zip_with(a["total"], b["least"], lambda x, y: x + y)
    return F.struct(F.zip_with(a["total"], b["total"], lambda x, y: x + y).alias("total"), F.zip_with(a["least"], after, lambda x, y: F.least(x, y)).alias("least"))


def reduced(tokens: DataFrame, sequence: str, pos: str, token: str, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], per_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """(sequence, n, stretch) of rows (sequence, pos, token): each sequence, in the order of pos from 0 on, as one stretch.

    Ranges are folded first, then `fan` neighbours are combined at a time, round by round; a round moves a row for each stretch.
    """
    told = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(token).cast("bigint").alias("token"))))
    ranged = tokens.groupBy(F.col(sequence), F.floor(F.col(pos) / per_range).cast("bigint").alias("at")).agg(told.alias("told"))
    parts = checkpointed(ranged.select(sequence, "at", F.size("told").cast("bigint").alias("n"), fold(F.transform("told", lambda x: x["token"])).alias("stretch")))
    last = parts.agg(F.max("at")).first()[0] or 0
    while last > 0:
        near = F.array_sort(F.collect_list(F.struct("at", "n", "stretch")))
        met = parts.groupBy(sequence, F.floor(F.col("at") / fan).cast("bigint").alias("at")).agg(F.sum("n").alias("n"), F.transform(near, lambda x: x["stretch"]).alias("near"))
        joined = F.aggregate(F.slice("near", F.lit(2), F.size("near") - 1), F.element_at("near", 1), join)
        parts = checkpointed(met.select(sequence, "at", "n", F.when(F.size("near") == 1, F.element_at("near", 1)).otherwise(joined).alias("stretch")))
        last //= fan
    return parts.select(sequence, "n", "stretch")


def nested_validity(tokens: DataFrame, sequence: str, pos: str, token: str, symbols: int, per_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """(sequence, n, valid, unopened, unclosed): whether brackets match and none is left open; the brackets left of either side
    are null where some do not match."""
    made = reduced(tokens, sequence, pos, token, lambda t: nested_fold(t, symbols), nested_join(symbols), per_range, fan)
    closes, opens, ok = F.size("stretch.closes"), F.size("stretch.opens"), F.col("stretch.ok")
    return made.select(sequence, "n", (ok & (closes == 0) & (opens == 0)).alias("valid"), F.when(ok, closes).cast("bigint").alias("unopened"), F.when(ok, opens).cast("bigint").alias("unclosed"))


def counted_validity(tokens: DataFrame, sequence: str, pos: str, token: str, symbols: int, per_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """(sequence, n, valid): whether each symbol's brackets balance on their own, never closing more than are open."""
    made = reduced(tokens, sequence, pos, token, lambda t: counted_fold(t, symbols), counted_join, per_range, fan)
    return made.select(sequence, "n", (F.forall("stretch.least", lambda x: x >= 0) & F.forall("stretch.total", lambda x: x == 0)).alias("valid"))
