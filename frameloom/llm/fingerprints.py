"""SimHash fingerprints and searches within a Hamming radius, by DataFrame functions alone.

Terms are pairs of neighbouring words, weighted by how often they occur. Each occurrence votes on 64 bits; votes are summed
three to a 64-bit word, so that one hash aggregate with 22 sums counts them, combined on the map side. For a search the bits
are cut into blocks; one table for each choice of blocks that a near fingerprint can leave untouched is keyed by those blocks
(the prefix after a permutation), so every fingerprint within the radius meets the query in some table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, lower_ascii, table, whole

BITS, SPACING = 64, 22
#: Terms of a text that are summed in one group: a lane of a packed sum holds fewer than 2 ** 19 votes.
CHUNK = 500_000
RADIUS, BLOCKS = 3, 6


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def term_hashes(text: Column) -> Column:
    """A hash for each word with its follower (the last word alone); none for a text without words."""
    words = F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and simhash (bigint) of each text. Null, empty and blank texts have 0.

    Texts with the same keys must be the same: they vote alike, which changes nothing.
    """
    lanes = [sum(1 << s for s in (0, SPACING, 2 * SPACING) if s + j < BITS) for j in range(SPACING)]
    votes = texts.select(*keys, F.posexplode_outer(term_hashes(whole(text))).alias("at", "vote")).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    sums = [F.coalesce(F.sum(F.shiftrightunsigned("vote", j).bitwiseAND(F.lit(m))), F.lit(0)).alias(f"s{j}") for j, m in enumerate(lanes)]
    part = votes.groupBy(*keys, "chunk").agg(F.count("vote").alias("n"), *sums)
    lane = (1 << SPACING) - 1
    ones = [F.sum(F.shiftrightunsigned(f"s{i % SPACING}", SPACING * (i // SPACING)).bitwiseAND(F.lit(lane))).alias(f"c{i}") for i in range(BITS)]
    whole_ = part.groupBy(*keys).agg(F.sum("n").alias("n"), *ones)
    halves = []
    for half in (range(32), range(32, BITS)):
        bits = F.lit(0).cast("bigint")
        for i in half:
            bits = bits.bitwiseOR(F.when(F.col(f"c{i}") * 2 > F.col("n"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("bigint")))
        halves.append(bits)
    return whole_.select(*keys, halves[0].bitwiseOR(halves[1]).alias("simhash"))


def likeness(x: Column, y: Column) -> Column:
    """The estimated cosine of two fingerprints' weighted terms, at least 0; 1 for equal fingerprints."""
    return F.greatest(F.cos(F.bit_count(x.bitwiseXOR(y)) * F.lit(3.141592653589793 / BITS)), F.lit(0.0))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the tables: each choice of blocks - radius of the blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be more than radius")
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def hamming_search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, simhash, distance) of distinct fingerprints at most `radius` bits apart, each pair once.

    Both inputs have a column simhash; rows that repeat one, and nulls, add nothing.
    """
    masks = [F.lit(_signed(m)) for m in block_masks(radius, blocks)]
    keyed = lambda c: F.posexplode(F.array(*[F.col(c).bitwiseAND(m) for m in masks])).alias("t", "key")
    left = queries.where("simhash is not null").select(F.col("simhash").alias("query")).distinct().select("query", keyed("query"))
    right = prints.where("simhash is not null").select("simhash").distinct().select("simhash", keyed("simhash"))
    apart = F.col("query").bitwiseXOR(F.col("simhash"))
    first = F.lit(len(masks))
    for t, m in reversed(list(enumerate(masks))):
        first = F.when(apart.bitwiseAND(m) == 0, F.lit(t)).otherwise(first)
    met = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.bit_count(apart) <= radius) & (first == F.col("l.t"))
    return left.alias("l").join(right.alias("r"), met).select("query", "simhash", F.bit_count(apart).alias("distance"))


def with_next(rows: DataFrame) -> DataFrame:
    """rows of (doc_id, k, h, ...) with next_k and next_h of the row that follows by (doc_id, h); the first follows the last.

    Nulls come first. (k, h) must be distinct. Rows are sorted in ranges; one row a range meets the next range's first.
    """
    ranged = checkpointed(rows.repartitionByRange("doc_id", "h").withColumn("range", F.spark_partition_id()))
    me = F.struct("doc_id", "h", "k")
    firsts = ranged.groupBy("range").agg(F.min(me).alias("first"))
    order = Window.orderBy("range")  # a row for each range
    heads = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("head"))
    inside = F.lead(me).over(Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "h"))
    joined = ranged.withColumn("inside", inside).join(F.broadcast(heads), "range").withColumn("following", F.coalesce("inside", "head"))
    return joined.select(*rows.columns, F.col("following.k").alias("next_k"), F.col("following.h").alias("next_h"))


def edited_texts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, h, n_chars, next_k, next_h) and (k, h, body, edited): a text's last quarter gives way to the next one's start.

    (k, h), an id without null and a hash of the text, tells documents apart. Both joins use one shuffle of the texts.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64(F.col("doc_id").isNull(), whole(text)).alias("h")]
    body = docs.select(*key, whole(text).alias("body")).dropDuplicates(["k", "h"])
    rows = docs.select("doc_id", *key, F.length(whole(text)).cast("bigint").alias("n_chars")).distinct()
    chain = checkpointed(with_next(rows))
    taken = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = chain.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("for_k"), F.col("h").alias("for_h"), taken.alias("taken"))
    heads = body.join(wanted, ["k", "h"]).select(F.col("for_k").alias("k"), F.col("for_h").alias("h"), F.substring("body", F.lit(1), F.col("taken")).alias("head"))
    kept = F.substring("body", F.lit(1), F.length("body") - F.floor(F.length("body") / 4).cast("int"))
    return chain, body.join(heads, ["k", "h"]).select("k", "h", "body", F.concat(kept, F.col("head")).alias("edited"))


def edit_fingerprints(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs.

    near_docs is, for ids divisible by 20, how many other documents have a fingerprint within the radius; null for others.
    Null texts count as empty; long ones count whole, their votes summed in chunks of CHUNK terms. Rows that repeat an id are
    ordered by their texts' hashes; rows that repeat id and text are one document. A null id comes first in the order. Columns
    other than doc_id and the text are not read, whatever their names. An empty table gives no rows; a single document follows
    itself. Bits on which votes are tied stay 0.
    """
    chain, texts = edited_texts(docs, text)
    sides = texts.select("k", "h", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("digest"), F.posexplode(F.array("body", "edited")).alias("side", "text"))
    found = checkpointed(fingerprints(sides, ["k", "h", "digest", "side"]))
    of_side = lambda side: F.max(F.when(F.col("side") == side, F.col("simhash")))
    pair = found.groupBy("k", "h", "digest").agg(of_side(0).alias("own"), of_side(1).alias("after_edit")).join(chain, ["k", "h"])
    own = found.where("side = 0").select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("simhash").alias("next_print"))
    joined = pair.join(own, ["next_k", "next_h"])
    prints = checkpointed(found.where("side = 0").groupBy("simhash").count())
    asked = pair.where("doc_id % 20 = 0").select(F.col("own").alias("simhash"))
    near = hamming_search(asked, prints, radius).join(prints, "simhash").groupBy("query").agg(F.sum("count").alias("hits"))
    near = checkpointed(near)
    out = joined.join(broadcast_if_few(near), (F.col("own") == F.col("query")) & (F.col("doc_id") % 20 == 0), "left")
    text_of = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), text_of("own").alias("fingerprint"), text_of("after_edit").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after_edit")).alias("near_edited"), likeness(F.col("own"), F.col("next_print")).alias("near_next"), (F.col("hits") - 1).alias("near_docs"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))
