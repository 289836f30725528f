"""Mixing sources by temperature, by DataFrame functions alone.

A source's weight is its token share raised to an exponent and normalised. The exponent is bisected until the weights reach a
target entropy, or until no source is repeated more often than a limit allows. Weights become budgets of tokens. Each source
is a stream of its documents in a seeded permutation, block by block, over and over; its budget says how far the stream is
read. Where a document stands follows from sums by block and a running sum within its block, both about the square root of
the source's size, so no source is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, fresh, table, whole

#: No source is read more often than this, the seed of the permutations, and sources whose shares the driver holds; the sums over
#: more are taken by Spark.
REPEAT, SEED, SOURCES = 1.5, 17, 100_000


def weights_at(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; a source without tokens has no weight."""
    logs = [exponent * math.log(s) if s > 0 else -math.inf for s in shares]
    top = max(logs, default=0.0)
    raised = [math.exp(x - top) if s > 0 else 0.0 for x, s in zip(logs, shares, strict=True)]
    total = math.fsum(raised)
    return [r / total for r in raised] if total else raised


def entropy(weights: list[float]) -> float:
    """In bits."""
    return -math.fsum(w * math.log2(w) for w in weights if w > 0)


def repeats(shares: list[float], weights: list[float], budget: float | None) -> list[float]:
    """How often each source is read: for a budget as a share of all tokens, or, without one, so that each is read at least once."""
    times = [w / s if s > 0 else 0.0 for w, s in zip(weights, shares, strict=True)]
    scale = budget if budget is not None else 1 / min((t for t in times if t > 0), default=1.0)
    return [t * scale for t in times]


def bisected(enough, max_repeat: float | None, rounds: int = 60) -> float:
    """The smallest exponent in 0..1 that is enough, which 1 is unless the budget alone repeats a source too often."""
    if enough(0.0):
        return 0.0
    if not enough(1.0):
        if max_repeat is not None:
            raise ValueError("the budget repeats a source too often even without mixing")
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def _one_goal(target_entropy: float | None, max_repeat: float | None) -> None:
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give either a target entropy or a repetition limit")


def solve(shares: list[float], target_entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None, rounds: int = 60) -> float:
    """The exponent in 0..1: nearest to the target entropy, or the smallest that keeps every source within max_repeat.

    Entropy falls and repetition falls as the exponent rises from 0 (all sources alike) to 1 (as they are). If 1 still repeats
    too often, the budget alone is too large and a ValueError says so.
    """
    _one_goal(target_entropy, max_repeat)

    def enough(x: float) -> bool:
        w = weights_at(shares, x)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        return max(repeats(shares, w, budget), default=0.0) <= max_repeat * (1 + 1e-12)

    return bisected(enough, max_repeat, rounds) if any(shares) else 1.0


def solve_sums(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None, rounds: int = 60) -> tuple[float, float, float]:
    """The same exponent for shares (column share, materialised) of any number of sources, the sum of their powers, and how often
    weight / share counts. Each evaluation is one aggregate; the driver sees its sums alone.
    """
    _one_goal(target_entropy, max_repeat)
    logs = shares.where("share > 0").select(F.log("share").alias("x"))
    ends = logs.agg(F.min("x").alias("least"), F.max("x").alias("most")).first()
    if ends["least"] is None:
        return 1.0, 1.0, 0.0

    def sums(e: float) -> tuple[float, float]:
        power = F.exp(F.col("x") * F.lit(e))
        return tuple(logs.agg(F.sum(power), F.sum(power * F.col("x"))).first())

    def scale(e: float, total: float) -> float:  # the largest source is the least repeated
        return budget if budget is not None else total / math.exp((e - 1) * ends["most"])

    def enough(e: float) -> bool:
        total, weighted = sums(e)
        if target_entropy is not None:
            return math.log2(total) - e * weighted / (total * math.log(2)) <= target_entropy
        return math.exp((e - 1) * ends["least"]) / total * scale(e, total) <= max_repeat * (1 + 1e-12)

    exponent = bisected(enough, max_repeat, rounds)
    total = sums(exponent)[0]
    return exponent, total, scale(exponent, total)


def default_tokens(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


PLAN = "of string, epoch_tokens bigint, budget_tokens bigint, weight double, exponent double, blocks bigint"


def source_plan(per: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: float | None) -> DataFrame:
    """Rows of PLAN for sources (source, epoch, n), materialised: their budgets and weights. Broadcast up to SOURCES rows."""
    if per.count() <= SOURCES:
        held = per.orderBy("source").collect()
        total = sum(r["epoch"] for r in held)
        shares = [r["epoch"] / total if total else 0.0 for r in held]
        exponent = solve(shares, target_entropy, max_repeat, budget)
        weights = weights_at(shares, exponent)
        often = repeats(shares, weights, budget)
        plan = [(r["source"], r["epoch"], int(round(o * r["epoch"])), w, float(exponent), math.isqrt(r["n"] - 1) + 1) for r, o, w in zip(held, often, weights, strict=True)]
        return F.broadcast(per.sparkSession.createDataFrame(plan, PLAN))
    total = per.agg(F.sum("epoch")).first()[0]
    shared = checkpointed(per.withColumn("share", F.col("epoch") / F.lit(max(total, 1))))
    exponent, powers, scale = solve_sums(shared, target_entropy, max_repeat, budget)
    weight = F.when(F.col("share") > 0, F.exp(F.log("share") * exponent) / powers).otherwise(F.lit(0.0))
    reads = F.when(F.col("share") > 0, F.rint(weight / F.col("share") * scale * F.col("epoch"))).otherwise(F.lit(0.0)).cast("bigint")
    blocks = F.floor(F.sqrt((F.col("n") - 1).cast("double"))).cast("bigint") + 1
    return checkpointed(shared.select(F.col("source").cast("string").alias("of"), F.col("epoch").alias("epoch_tokens"), reads.alias("budget_tokens"), weight.alias("weight"), F.lit(float(exponent)).alias("exponent"), blocks.alias("blocks")))


def copies(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None, seed: int = SEED, text: str = "text", source: str = "source", tokens=default_tokens) -> DataFrame:
    """(doc_id, source, h, tokens, copies, start, epoch_tokens, budget_tokens, weight, exponent) for each distinct (doc_id, source, text).

    start counts the tokens ahead in the source's permuted stream. copies is how often the stream, read for budget_tokens, has
    the document. Documents without tokens (null, empty or blank texts) cost nothing and are kept once. A null source is a source
    of its own; null ids are documents like others; ties of the permutation's hash fall by id and text. Long texts are counted
    whole. Only the id, the source and the text are read, whatever other columns are called. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col(source).alias("source"), F.xxhash64(whole(text)).alias("h"), tokens(whole(text)).alias("t"))
    rows = checkpointed(rows.groupBy("doc_id", "source", "h").agg(F.max("t").alias("tokens"), F.sum("t").alias("cost")))
    per = checkpointed(rows.groupBy("source").agg(F.sum("cost").alias("epoch"), F.count(F.lit(1)).alias("n")))
    spec = source_plan(per, target_entropy, max_repeat, budget)
    key = F.xxhash64(F.lit(seed), "doc_id", "h")
    placed = rows.withColumn("order", key).join(spec, F.col("source").cast("string").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "h"), "blocks"))
    sums = checkpointed(placed.groupBy("of", "block").agg(F.sum("cost").alias("sum")))
    ahead = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = checkpointed(sums.select(F.col("of").alias("of2"), F.col("block").alias("block2"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead")))
    within = Window.partitionBy("of", "block").orderBy("order", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    told = placed.withColumn("within", F.coalesce(F.sum("cost").over(within), F.lit(0))).join(sums, F.col("of").eqNullSafe(F.col("of2")) & (F.col("block") == F.col("block2")))
    start = F.col("ahead") + F.col("within")
    read = F.col("budget_tokens") - start
    times = F.when(F.col("cost") == 0, F.lit(1)).when(read <= 0, F.lit(0)).otherwise(F.ceil(read / F.col("epoch_tokens")))
    return told.select("doc_id", "source", "h", "tokens", times.cast("int").alias("copies"), start.alias("start"), "epoch_tokens", "budget_tokens", "weight", "exponent")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per reading of a document: doc_id, source, copy (from 1), tokens, position, mix_order, weight, exponent.

    position counts the tokens of the source's stream ahead of it; mix_order, from 0 to 1, is the share of the source's budget
    ahead, so rows sorted by it have the target weights in every stretch. Repeated rows of one id, source and text are one row
    here. An empty table gives no rows.
    """
    told = copies(docs, **options).where("copies > 0")
    rows = told.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    position = F.col("start") + (F.col("copy") - 1) * F.col("epoch_tokens")
    order = F.when(F.col("budget_tokens") > 0, position / F.col("budget_tokens")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "source", "copy", "tokens", position.alias("position"), order.alias("mix_order"), "weight", "exponent")


def mix(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as its source's budget reads it, with docs' columns, in the order of mix_order.

    Rows are range-partitioned and sorted by it, so what is written has the target weights in every stretch. Texts are joined
    without a shuffle where few rows say how often, and move once for the order.

    A null text is empty and has no tokens; a null source is a source of its own; a null id is read like others. Rows that repeat
    id, text and source go together, each as often as the others. Other columns are carried along under any name. No row gives none.
    """
    h, doc, of, hash_, copy, order = fresh(docs, "h", "mix_doc", "mix_source", "mix_hash", "copy", "mix_order")
    told = copies(docs, text=text, source=source, **options).where("copies > 0")
    told = told.select(F.col("doc_id").alias(doc), F.col("source").alias(of), F.col("h").alias(hash_), F.sequence(F.lit(1), "copies").alias(copy), "start", "epoch_tokens", "budget_tokens")
    ahead = lambda c: (F.col("start") + (c - 1) * F.col("epoch_tokens")) / F.col("budget_tokens")
    told = told.select(doc, of, hash_, F.when(F.col("budget_tokens") > 0, F.transform(copy, ahead)).otherwise(F.array(F.lit(0.0))).alias(order))
    wide = docs.withColumn(h, F.xxhash64(whole(text)))
    met = wide.join(broadcast_if_few(checkpointed(told)), wide["doc_id"].eqNullSafe(F.col(doc)) & (wide[h] == F.col(hash_)) & wide[source].eqNullSafe(F.col(of)))
    placed = met.withColumn(order, F.explode(order))
    return placed.repartitionByRange(order, h).sortWithinPartitions(order, h).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_rows(table(spark, sf_dir, "documents"), max_repeat=REPEAT)
