"""Interaction audit of filters that run one after another.

Each document becomes a mask with a bit for every filter that it fails, and documents are counted by cells (part, mask). The
cells, at most 32 for a part, are unpivoted against the steps of all orders of the filters. A running bit-or over a cell's steps
says what failed before, conditional sums over the cells give what each step keeps and removes, and a window over all steps of
one filter gives its total over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, table, whole

FILTERS = "ABCDE"
#: Bytes between words, and marks that no clean text holds.
BLANKS, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def text_failures(text: Column) -> Column:
    """Bits of filters A to D that a text fails: few words, repeated words, capitals, marks. All need the text alone."""
    words = F.array_remove(F.split(text, BLANKS), "")
    short = F.when(F.size(words) < LEAST_WORDS, 1).otherwise(0)
    dull = F.when(100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words), 2).otherwise(0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = F.when(100 * capitals > MOST_CAPITALS * F.length(text), 4).otherwise(0)
    marked = F.when(text.rlike(MARKS), 8).otherwise(0)
    return short + dull + loud + marked


def failure_cells(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, and how many of them are labelled good and toxic.

    Null texts are empty, and fail A alone unless they repeat; null parts are the empty string. E fails where a smaller doc_id has
    the same text anywhere in the table, so of rows that repeat both id and text none fails by the others; a null doc_id fails by
    any id with its text. A document is good (toxic) if any of its label rows says so; labels of unknown ids count for nothing.
    Texts are read once; after that rows are an id, a digest and the mask.
    """
    body = whole(text)
    rows = checkpointed(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), text_failures(body).alias("mask")))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("known")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).where("good or toxic")
    repeated = rows.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("same", "first")
    joined = rows.join(broadcast_if_few(checkpointed(known)), F.col("doc_id") == F.col("known"), "left").join(broadcast_if_few(checkpointed(repeated)), F.col("digest") == F.col("same"), "left")
    again = F.coalesce(F.when(F.col("doc_id").isNull(), F.col("first").isNotNull()).otherwise(F.col("first") < F.col("doc_id")), F.lit(False))
    cells = joined.select("part", (F.col("mask") + F.when(again, 16).otherwise(0)).cast("int").alias("mask"), "good", "toxic")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), 1)), F.lit(0)).cast("bigint")
    return cells.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step of it, with its counts; cells has (part, mask, n, good, toxic).

    Bit i of a mask stands for the i-th letter of `filters`. Every part of cells has all rows, zeros included; no cells, no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    ordered = cells.select("*", F.explode(orders).alias("filter_order"))
    steps = ordered.select("*", F.posexplode(F.array(*[F.substring("filter_order", i + 1, 1) for i in range(len(filters))])).alias("at", "filter"))
    steps = steps.withColumn("step", F.col("at") + 1).withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    seen = steps.withColumn("fails", fails != 0).withColumn("earlier", F.coalesce(F.bit_or(fails).over(before), F.lit(0)) != 0)
    total = lambda when, what="n": F.coalesce(F.sum(F.when(F.expr(when), F.col(what))), F.lit(0)).cast("bigint")
    counts = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total("not earlier and not fails").alias("kept"),
        total("fails and not earlier").alias("removed"),
        total("fails and earlier").alias("redundant"),
        total("mask = bit").alias("unique_fails"),
        total("fails and not earlier", "good").alias("good_lost"),
        total("fails and not earlier", "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    cells = checkpointed(failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return audit(cells).drop("filter")


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (
  SELECT w.doc_id, part, len(ws) < 100 AS fa, 100 * len(list_distinct(ws)) < 80 * len(ws) AS fb,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
    w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS fe FROM w),
k AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, MAP {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS m, fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM f LEFT JOIN k USING (doc_id)),
c AS (SELECT part, m, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails, m[filter_order[step]] AS own,
  list_bool_or(list_transform(range(1, step), lambda i: m[filter_order[i]])) AS earlier FROM c, s),
g AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (WHERE NOT own AND NOT coalesce(earlier, false)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE own AND NOT coalesce(earlier, false)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE own AND coalesce(earlier, false)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE own AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE own AND NOT coalesce(earlier, false)), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE own AND NOT coalesce(earlier, false)), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
