"""Exact duplicates by a heavy-hitter split.

A Misra-Gries sketch (Spark's frequent-items aggregate, which merges partial sketches) names digests that may be frequent;
one map-side combined count verifies them. The verified ones, at most TRACKED rows of fixed width, are broadcast, so rows of
hot groups meet their winner without a shuffle; all other digests are shuffled in the ordinary way, their groups summed on the
map side first and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, fresh, table, whole

#: Digests reported by the sketch at most, and counters it keeps: its error is below 4 rows in CAPACITY.
TRACKED, CAPACITY = 1000, 8192


def heavy_digests(digests: DataFrame, digest: str = "digest", least: int = 64, tracked: int = TRACKED, capacity: int = CAPACITY) -> DataFrame:
    """The digests that the sketch finds frequent, with exact group_size and keep_id; at most `tracked` rows."""
    found = digests.agg(F.call_function("approx_top_k", F.col(digest), F.lit(tracked), F.lit(capacity)).alias("top"))
    named = found.select(F.explode("top.item").alias(digest))
    exact = digests.join(F.broadcast(named), digest, "left_semi").groupBy(digest).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return checkpointed(exact.where(F.col("group_size") >= least))


def split_groups(digests: DataFrame, least: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent digests, and rows (doc_id, digest, keep_id, group_size) of these and of all others. digests should be
    materialised: it is read three times."""
    heavy = heavy_digests(digests, least=least)
    hot = digests.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", "group_size")
    others = digests.join(F.broadcast(heavy), "digest", "left_anti")
    groups = others.groupBy(F.col("digest").alias("of")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = others.join(groups, F.col("digest") == F.col("of")).select("doc_id", "digest", "keep_id", "group_size")
    return heavy, hot, rest


def exact_groups(docs: DataFrame, text: str = "text", normalise=lambda c: c, least: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after `normalise` (nothing by default); null counts as empty. The largest doc_id of a
    group stays; a null doc_id stays only where the group has no other. Rows that repeat the id that stays are the same
    document and all count as kept. An empty table gives no rows.
    """
    digests = checkpointed(docs.select(F.col("doc_id"), F.sha2(normalise(whole(text)), 256).alias("digest")))
    _, hot, rest = split_groups(digests, least)
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact(docs: DataFrame, text: str = "text", normalise=lambda c: c, least: int = 64) -> DataFrame:
    """The documents that stay, one row for each distinct text, with docs' columns.

    Rows of frequent digests go where they are read, by the broadcast winners; of the other digests only ids and digests are
    shuffled, and texts move only where more ids go than a broadcast may hold. Of rows that repeat both the id and the text one
    stays, any of them where other columns differ. Null ids, long texts, ties and empty tables are as in exact_groups.
    """
    digest, doc, of, keep = fresh(docs, "digest", "gone_doc", "gone_digest", "keep_id")
    keyed = docs.withColumn(digest, F.sha2(normalise(whole(text)), 256))
    heavy, hot, rest = split_groups(checkpointed(keyed.select("doc_id", F.col(digest).alias("digest"))), least)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named = [F.col("doc_id").alias(doc), F.col("digest").alias(of)]
    lost = checkpointed(rest.where(~stays).select(*named).distinct())
    again = checkpointed(hot.unionByName(rest.where("group_size > 1")).where(stays).groupBy(*named).count().where("count > 1").drop("count"))
    winners = F.broadcast(heavy.select(F.col("digest").alias(of), F.col("keep_id").alias(keep)))  # at most TRACKED rows
    won = keyed.join(winners, F.col(digest) == F.col(of), "left").where(F.col(of).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))).drop(of, keep)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(digest) == F.col(of))
    won = won.join(broadcast_if_few(lost), same, "left_anti")
    if again.isEmpty():
        return won.select(*docs.columns)
    one = won.join(broadcast_if_few(again), same, "left_semi").dropDuplicates(["doc_id", digest])
    return won.join(broadcast_if_few(again), same, "left_anti").unionByName(one).select(*docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) WINDOW w AS (PARTITION BY h)
"""
