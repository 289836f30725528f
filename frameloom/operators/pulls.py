"""How bodies on a line pull at each other, without a row for each pair.

The pull at x of a body at y is d / (d * d + 1) ** 1.5, with d = y - x. It has no pole nearer than 1 to the line, so over a cell that is
narrow, or far from the other body, it is a polynomial of a low degree to the last digits of a double. Cells of half a unit hold
sums of Chebyshev polynomials of their bodies, and cells of twice the width those of their halves, level by level. Each cell meets
cells of its own level that are near its parent and not near itself, at most three; cells of the lowest level meet those near them
and themselves, too. Work grows with the bodies (times the levels, for cells that hold any), and what is left out is less than what
the rounding of a sum of all pairs leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from frameloom.lineage import broadcast_if_few, checkpointed
from frameloom.operators.stats import pairwise
from frameloom.workers import ship

#: Polynomials of a cell. Errors fall with (3 + sqrt(8)) ** -NODES, 5e-16, at the nearest of the cells that meet.
NODES = 20
#: Of cells of the lowest level: a quarter of a unit from middle to edge, where the nearest poles are 1 away.
WIDTH = 0.5
#: Cells are numbered for bodies nearer to 0 than this.
REACH = 2.0**40

_K = np.arange(NODES)


def polynomials(t: np.ndarray) -> np.ndarray:
    """Chebyshev polynomials of degree 0 .. NODES - 1 at t, along a new last axis."""
    return np.cos(_K * np.arccos(np.clip(t, -1, 1))[..., None])


_AT = np.cos(np.pi * (_K + 0.5) / NODES)
#: From sums of polynomials to weights of the nodes (sums @ _C.T), and from values at the nodes to coefficients (values @ _C).
_C = polynomials(_AT) * np.where(_K == 0, 1, 2) / NODES


def pull(d):
    return d / np.power(d * d + 1, 1.5)


def _within(leaf: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(row, node, degree): a higher cell's polynomials at the nodes of a lowest cell in it."""
    size = np.exp2(level.astype(float))
    place = (leaf - ((leaf >> level) << level)).astype(float)
    return polynomials(2 * (place[:, None] + (_AT + 1) / 2) / size[:, None] - 1)


def _rise(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[pd.DataFrame]:
    for at in batches:
        leaf, weights = at["_cell"].to_numpy(np.int64), np.stack(at["_c"]) @ _C.T if len(at) else []
        for level in range(levels if len(at) else 0):
            told = np.einsum("rk,rkm->rm", weights, _within(leaf, np.full(len(at), level)))
            yield at.assign(_level=np.int32(level), _cell=leaf >> level, _c=list(told))


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for every in batches:
        for level, at in every.groupby("_level"):
            cell, weights, wide = at["_cell"].to_numpy(np.int64), np.stack(at["_c"]) @ _C.T, WIDTH * 2.0**level
            for o in range(-3, 4) if level == 0 else (-3, -2, 2, 3):
                near = np.abs(((cell + o) >> 1) - (cell >> 1)) <= 1
                if not near.any():
                    continue
                values = weights[near] @ pull((_AT[:, None] / 2 - _AT / 2 - o) * wide)
                yield at[near].assign(_cell=cell[near] + o, _c=list(values @ _C))


def _fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for at in batches:
        if len(at):
            leaf, level = at["_leaf"].to_numpy(np.int64), at["_level"].to_numpy(np.int64)
            values = np.einsum("rm,rkm->rk", np.stack(at["_c"]), _within(leaf, level))
            yield at.assign(_cell=leaf, _c=list(values @ _C)).drop(columns=["_leaf", "_level"])


def _sums(*parts: Column) -> Column:
    return F.array(*map(F.sum, parts)).alias("_c")


def pulls(rows: DataFrame, system: list[str], body: str, at: str) -> DataFrame:
    """(system..., body, pull): the sum of what the other bodies of its system do to each, for bodies that have others; what is at
    null does not count, and has a null pull, as has what meets such bodies alone.

    Rows of one body are summed; pulls among them cancel. Systems with a body that is not finite or beyond REACH go pair by pair.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [f"_y{i}" for i in range(len(system))]
    kept = rows.select(*[F.col(c).alias(n) for c, n in zip(system, names, strict=True)], F.col(body).alias("_body"), F.col(at).cast("double").alias("_at")).dropna(subset=[*names, "_body"])
    per = kept.groupBy(*names, "_body").agg(F.count("_at").alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high"))
    told = per.groupBy(*names).agg(F.count(F.lit(1)).alias("_bodies"), F.sum("n").alias("_known"), F.min("low").alias("_low"), F.max("high").alias("_high")).where("_bodies > 1")
    odd = (F.coalesce(F.greatest(-F.col("_low"), F.col("_high")), F.lit(0.0)) >= REACH).alias("_odd")
    told = checkpointed(told.select(*names, "_bodies", "_known", "_low", "_high", odd))
    low, high, strange = told.agg(F.min(F.when(~F.col("_odd"), F.col("_low"))), F.max(F.when(~F.col("_odd"), F.col("_high"))), F.count_if("_odd")).first()
    met = kept.join(broadcast_if_few(told.select(*names, "_known", "_odd")), names)

    leaf = F.floor(F.col("_at") / WIDTH).cast("bigint")
    turn = F.acos((F.col("_at") / WIDTH - leaf) * 2 - 1)
    plain = met.where(~F.col("_odd")).withColumn("_cell", leaf)
    first, last, levels = int(np.floor((low or 0.0) / WIDTH)), int(np.floor((high or 0.0) / WIDTH)), 1
    while (last >> (levels - 1)) - (first >> (levels - 1)) > 1:
        levels += 1
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*names).schema)
    each = [F.col("_c")[i] for i in range(NODES)]
    leaves = checkpointed(plain.where("_at IS NOT NULL").groupBy(*names, "_cell").agg(_sums(*[F.cos(turn * i) for i in range(NODES)])))
    cells = leaves.mapInPandas(lambda b: _rise(b, levels), f"{shape}, _cell bigint, _c array<double>, _level int").groupBy(*names, "_level", "_cell").agg(_sums(*each))
    felt = cells.mapInPandas(_meet, f"{shape}, _level int, _cell bigint, _c array<double>").groupBy(*names, "_level", "_cell").agg(_sums(*each))
    under = leaves.select(*names, F.col("_cell").alias("_leaf"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")).withColumn("_cell", F.expr("shiftright(_leaf, _level)"))
    there = under.join(broadcast_if_few(checkpointed(felt)), [*names, "_level", "_cell"]).select(*names, "_leaf", "_level", "_c")
    there = there.mapInPandas(_fall, f"{shape}, _cell bigint, _c array<double>").groupBy(*names, "_cell").agg(_sums(*each))
    found = plain.join(broadcast_if_few(checkpointed(there)), [*names, "_cell"], "left")
    value = sum((each[i] * F.cos(turn * i) for i in range(1, NODES)), each[0])
    out = found.groupBy(*names, "_body", "_known").agg(F.sum(value).alias("pull"), F.count("_at").alias("_own"))
    out = out.select(*names, "_body", F.when(F.col("_known") > F.col("_own"), F.col("pull")).alias("pull"))
    if strange:
        d = F.col("b._at") - F.col("a._at")
        pairs = pairwise(met.where("_odd").select(*names, "_body", "_at"), names, "_body")
        out = out.unionByName(pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in [*names, "_body"]]).agg(F.sum(d / F.pow(d * d + 1, F.lit(1.5))).alias("pull")))
    return out.select(*[F.col(n).alias(c) for c, n in zip(system, names, strict=True)], F.col("_body").alias(body), "pull")
