"""Hard-negative mining by bit-sliced integer products.

Vectors are floored to integers. A row's components, shifted to be non-negative, are read plane by plane, most significant bits
first; after each plane the score of a pair is known to lie in an interval, whose width is the anchor's positive and negative
weight times what the missing planes can add. Pairs whose interval can no longer reach what their anchor asks for are dropped,
and what an anchor asks for rises as better rows are found. Once few pairs of a tile live, the remaining planes are added for
those alone. What is left at the last plane has exact scores.

Anchors are a stated query set. Anchors and rows are dealt to blocks of bounded size, each pair of blocks is one group wherever
Spark puts it, and groups return a few rows for each anchor, which a ranked window merges. Positives come from blocks within a
label, so a label that holds most rows has more blocks; negatives follow in a second pass that knows each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, python_ready, table

#: Vectors in a block, about: some MB at a time, whatever the input.
BLOCK = 8192
#: Anchors in a tile, rows in the first tile and in the largest, and the share of living pairs below which they are listed.
ANCHORS, FIRST, ROWS, FEW_LIVE = 512, 256, 2048, 1 / 16
_LEAST = -(1 << 62)


def quantised(vectors: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id", label: str | Column = "label") -> DataFrame:
    """(vec_id, label, q) of the rows that take part: floor(scale * component) of each component.

    Rows with a null id, label, vector or component, or a component that is not finite, are left out. Of rows that repeat an id
    the smallest (label, q) stays. An empty vector scores 0 with all; of vectors of different lengths the shorter one counts as
    padded with zeros.
    """
    x = F.col("x")
    fine = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(fine)
    rows = checkpointed(rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("q")))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return checkpointed(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def sliced_scores(anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int, few: float = FEW_LIVE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs whose inner product is at least the anchor's low and at most its high.

    Components lie in [-2**bits, 2**bits). Scores are exact: all sums stay below what the floats hold, or 64-bit integers are used.
    """
    reach = int(np.abs(anchors).sum(axis=1).max(initial=0)) << (bits + 1)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    shifted = rows + (1 << bits)
    a = anchors.astype(kind)
    more, less = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    score = np.repeat((-anchors.sum(axis=1) << bits).astype(kind)[:, None], len(rows), axis=1)
    live, pairs = allowed, None
    for k in range(bits, -1, -1):
        plane = ((shifted >> k) & 1).astype(kind)
        rest = (1 << k) - 1
        floor, top = low - rest * more, high - rest * less  # what the score so far must reach and may not pass
        if pairs is None:
            score += (a @ plane.T) * kind(1 << k)
            live = live & (score >= floor[:, None]) & (score <= top[:, None])
            if np.count_nonzero(live) <= few * live.size:
                pairs = np.nonzero(live)
                score = score[pairs]
        else:
            i, j = pairs
            for lo in range(0, len(i), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                score[some] += np.einsum("ij,ij->i", a[i[some]], plane[j[some]]) * kind(1 << k)
            stay = (score >= floor[i]) & (score <= top[i])
            pairs, score = (i[stay], j[stay]), score[stay]
    if pairs is None:
        pairs = np.nonzero(live)
        score = score[pairs]
    return pairs[0], pairs[1], score.astype(np.int64)


class Best:
    """The first `most` rows of each asker: by score, largest first, ties by smaller id."""

    def __init__(self, askers: int, most: int):
        self.most, self.worst = most, np.full(askers, _LEAST)
        self.at, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score, ids = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        nth = np.arange(len(at)) - first
        stay = nth < self.most
        last = nth == self.most - 1
        self.worst[at[last]] = score[last]
        self.at, self.score, self.id = at[stay], score[stay], ids[stay]


def tiles(n: int) -> Iterator[slice]:
    """Small tiles first, so that what anchors ask for is high when the large ones come."""
    at, size = 0, FIRST
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(ROWS, 2 * size)


def positives_of(dims: int, bits: int, most: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows, row_ids = left["vec_id"].to_numpy(), matrix(right["q"], dims), right["vec_id"].to_numpy()
        found = []
        for lo in range(0, len(ids), ANCHORS):
            own = ids[lo : lo + ANCHORS]
            a, best = matrix(left["q"].slice(lo, ANCHORS), dims), Best(len(own), most)
            for t in tiles(len(rows)):
                i, j, score = sliced_scores(a, rows[t], own[:, None] != row_ids[t][None, :], best.worst, np.full(len(own), -_LEAST), bits)
                best.add(i, score, row_ids[t][j])
            found.append((own[best.at], best.id, best.score))
        columns = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3)]
        return pa.table(columns, names=["anchor_id", "positive_id", "positive_score"])

    return run


def negatives_of(dims: int, bits: int, most: int, least_share: int, most_share: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = left["vec_id"].to_numpy(), left["label"].to_numpy()
        rows, row_ids, row_labels = matrix(right["q"], dims), right["vec_id"].to_numpy(), right["label"].to_numpy()
        found = []
        for lo in range(0, len(ids), ANCHORS):
            own, part = labels[lo : lo + ANCHORS], left["positives"].slice(lo, ANCHORS).combine_chunks()
            a = matrix(left["q"].slice(lo, ANCHORS), dims)
            of = np.repeat(np.arange(len(own)), np.diff(part.offsets.to_numpy()))  # the anchor of each positive
            asked = part.flatten()
            positive, goal = (pc.struct_field(asked, f).to_numpy(zero_copy_only=False) for f in ("positive_id", "positive_score"))
            floor, top = -(-least_share * goal // 100), most_share * goal // 100
            best = Best(len(of), most)
            for t in tiles(len(rows)):
                low, high = np.full(len(own), -_LEAST), np.full(len(own), _LEAST)
                wants = np.where(floor <= top, np.maximum(floor, best.worst), -_LEAST)
                np.minimum.at(low, of, wants)
                np.maximum.at(high, of, np.where(floor <= top, top, _LEAST))
                i, j, score = sliced_scores(a, rows[t], own[:, None] != row_labels[t][None, :], low, high, bits)
                starts, ends = np.searchsorted(of, i), np.searchsorted(of, i, side="right")
                pair = np.repeat(np.arange(len(i)), ends - starts)
                asker = np.arange(len(pair)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + starts[pair]
                fits = (score[pair] >= wants[asker]) & (score[pair] <= top[asker])
                best.add(asker[fits], score[pair[fits]], row_ids[t][j[pair[fits]]])
            found.append((ids[lo : lo + ANCHORS][of[best.at]], positive[best.at], goal[best.at], best.id, best.score))
        columns = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _blocks(count: Column | int, block: int) -> Column:
    return F.greatest(F.ceil((F.lit(count) if isinstance(count, int) else count) / block), F.lit(1)).cast("int")


def met(anchors: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over every pair of an anchor block and a row block of one group; anchors and rows have (grp, anchor_blocks, row_blocks)."""
    mine, all_ = F.pmod(F.xxhash64("vec_id"), "anchor_blocks").cast("int"), F.sequence(F.lit(0), F.col("anchor_blocks") - 1)
    its, every = F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int"), F.sequence(F.lit(0), F.col("row_blocks") - 1)
    left = anchors.withColumn("i", mine).withColumn("j", F.explode(every)).drop("anchor_blocks", "row_blocks")
    right = rows.withColumn("i", F.explode(all_)).withColumn("j", its).drop("anchor_blocks", "row_blocks")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may come from one table
    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(run, schema)


def first_of(df: DataFrame, by: list[str], score: str, key: str, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)).cast("int")).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least_share: int = 50, most_share: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, q), as `quantised` makes.

    anchor says which rows ask. Scores are integer inner products. Positives of an anchor are the first rows of its label beside
    itself; for each, the first rows of other labels whose score is least_share to most_share hundredths of the positive's come
    back, ranked from 1. Larger scores come first, ties by smaller id. An anchor that is alone in its label, and a positive
    with a score below 0 or without such a row, have none. No row gives none.
    """
    python_ready(rows.sparkSession)
    size = rows.agg(F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda v: F.greatest(v, -v - 1)))).alias("far"), F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("asking")).first()
    dims, bits = size.dims or 0, int(size.far or 0).bit_length()
    if dims << (2 * bits + 1) >= 1 << 62:
        raise ValueError(f"products of {dims} components of {bits} bits do not fit 64-bit integers")
    by_label = checkpointed(rows.groupBy(F.col("label").alias("grp")).agg(_blocks(F.count_if(anchor), block).alias("anchor_blocks"), _blocks(F.count(F.lit(1)), block).alias("row_blocks")))
    labelled = rows.join(broadcast_if_few(by_label), rows["label"] == by_label["grp"]).select("grp", "vec_id", "q", "anchor_blocks", "row_blocks", anchor.alias("asks"))
    near = met(labelled.where("asks").drop("asks"), labelled.drop("asks"), positives_of(dims, bits, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = first_of(near, ["anchor_id"], "positive_score", "positive_id", positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    dealt = [F.lit(0).alias("grp"), _blocks(size.asking, block).alias("anchor_blocks"), _blocks(size.n, block).alias("row_blocks")]
    asking = checkpointed(rows.where(anchor).join(near, "vec_id").select("vec_id", "label", "q", "positives", *dealt))
    far = met(asking, rows.select("vec_id", "label", "q", *dealt), negatives_of(dims, bits, negatives, least_share, most_share), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return first_of(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 3
"""
