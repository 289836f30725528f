"""Shards of bounded size by extendible hashing, by DataFrame functions alone.

A shard is a prefix of a hash's bits. The directory starts with the whole table as one bucket; in each round the buckets that
hold more than the limit are split on further bits, STEP at a time, and every bucket closes at the first bit at which it fits.
Only sums by prefix are shuffled; rows keep 64 hash bits and their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, fresh, table, whole

#: Bytes of a shard at most, and bits that a round looks ahead.
LIMIT, STEP = 32 << 20, 8


def prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


def split_round(rows: DataFrame, depth: int, limit: int, step: int = STEP) -> DataFrame:
    """(fine, parent, depth, bytes, docs) for each prefix of depth + step bits of rows (h, bytes); depth is null where no bit up to there fits.

    A bucket closes where its bytes are within the limit, or where all its rows have one hash and no bit can part them.
    """
    fine = rows.groupBy(prefix(F.col("h"), depth + step).alias("fine")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    fine = fine.withColumn("parent", F.shiftright("fine", step))
    shut = F.lit(None).cast("struct<depth:int,bytes:bigint,docs:bigint>")
    for d in reversed(range(depth, depth + step + 1)):
        over = Window.partitionBy("parent", F.shiftright("fine", depth + step - d))
        total, docs = F.sum("b").over(over), F.sum("n").over(over)
        fits = (total <= limit) | (F.min("lo").over(over) == F.max("hi").over(over))
        shut = F.when(fits, F.struct(F.lit(d).alias("depth"), total.alias("bytes"), docs.alias("docs"))).otherwise(shut)
    return fine.withColumn("shut", shut).select("fine", "parent", F.col("shut.depth").alias("depth"), F.col("shut.bytes").alias("bytes"), F.col("shut.docs").alias("docs"))


def row_hash(text: Column) -> Column:
    return F.xxhash64("doc_id", text)


def hashed_shards(docs: DataFrame, limit: int, text: str) -> DataFrame:
    """Rows of assign_shards with their hash h, of which shard is a prefix."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    body = whole(text)
    rows = checkpointed(docs.select("doc_id", row_hash(body).alias("h"), F.octet_length(body).cast("bigint").alias("bytes")))
    left, done, depth = rows, [], 0
    while depth < 64:
        found = checkpointed(split_round(left.select("h", "bytes"), depth, limit))
        done.append((left, found, depth + STEP))
        depth += STEP
        open_ = found.where("depth is null").select(F.col("fine").alias("open"))
        if open_.isEmpty():
            break
        left = checkpointed(left.join(open_, prefix(F.col("h"), depth) == F.col("open"), "left_semi"))
    out = None
    for part, found, at in done:
        shut = found.where("depth is not null").select("fine", "depth", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
        here = part.join(shut, prefix(F.col("h"), at) == F.col("fine"))
        out = here if out is None else out.unionByName(here)
    bits = F.substring(F.lpad(F.bin("h"), 64, "0"), F.lit(1), F.col("depth"))
    return out.select("h", "doc_id", "bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit).alias("fits"))


def assign_shards(docs: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """One row per document: doc_id, bytes, shard, depth, shard_bytes, shard_docs, fits.

    bytes are those of the text in UTF-8 (null: 0); shard spells the depth bits, and is empty where one shard holds all. Rows
    that repeat an id and a text have one hash and stay together; where these alone, or one text, however long, exceed the limit,
    fits is false. Ids that repeat with other texts, and null ids, have rows of their own. Only doc_id and the text are read,
    whatever other columns are called. An empty table gives no rows.
    """
    return hashed_shards(docs, limit, text).drop("h")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> None:
    """Write docs, every row once and with all columns, as Parquet with a folder for each shard.

    Folders are named shard=..., with underscores behind `shard` where docs has such a column. A row finds its shard by its hash
    of id and text, so rows that repeat an id are neither lost nor multiplied. A shard's rows meet in one task, which its limit
    bounds but for what no split can part. A null text weighs nothing and stays null; null ids are written; an empty table
    writes no shard.
    """
    shard, h, of = fresh(docs, "shard", "h", "of")
    where = checkpointed(hashed_shards(docs, limit, text).select(F.col("h").alias(of), F.col("shard").alias(shard)).distinct())
    joined = docs.withColumn(h, row_hash(whole(text))).join(broadcast_if_few(where), F.col(h) == F.col(of)).drop(h, of)
    joined.repartition(shard).write.partitionBy(shard).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
