"""Secrets: fixed patterns, and strings that look random to Markov models of characters, by DataFrame functions alone.

Two first-order models over character transitions, one of random strings and one of ordinary identifiers, are trained from
labelled samples: random strings are values that the patterns find plus a seeded set, ordinary ones are long words of a bounded
sample of documents. A candidate's summed log-likelihood ratio, a mean per transition, decides; the threshold is what no more
than a small share of the ordinary samples exceeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameloom.llm._common import checkpointed, table, whole

#: The patterns of the base kinds, in the order in which kinds are listed, and the least length of what counts.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
VALUE = 6
#: Candidates of the models: runs of these characters of this length at least.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
#: Documents whose long words are ordinary samples, the seeded random samples, and the share of ordinary samples let through.
SAMPLE_DOCS, SEEDED, LET_THROUGH = 4000, 2000, 0.005
#: Words of the ordinary samples have this length at least.
ORDINARY = 8


def running_sums(numbers: Column, most: int = 1024) -> Column:
    """For each element of an array the sum of those ahead of it.

    A fold that appends copies its array at every step, so it runs over blocks of elements and then over the blocks' sums: time
    grows with the 1.5th power of the array's size at most, and up to `most` squared elements copies stay short.
    """
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.aggregate(c, zero, lambda acc, x: acc + x)
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.sqrt(F.size(numbers).cast("double"))))).cast("int")
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    ahead = lambda c: F.aggregate(c, start, step, lambda acc: acc["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / size).cast("int") - 1), lambda i: F.slice(numbers, i * size + 1, size))
    placed = F.zip_with(blocks, ahead(F.transform(blocks, total)), lambda block, before: F.transform(ahead(block), lambda x: x + before))
    return F.when(F.size(numbers) > 0, F.flatten(placed)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, value>>: all leftmost matches that do not overlap; starts in code points.

    What a split leaves between the matches gives their places.
    """
    none = F.array().cast("array<struct<start:int,value:string>>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("value")))

    def placed(x: Column) -> Column:
        ahead = running_sums(F.transform(x, lambda m: (m["gap"] + m["size"]).cast("bigint")))
        return F.zip_with(x, ahead, lambda m, at: F.struct((at + m["gap"]).cast("int").alias("start"), m["value"].alias("value")))

    # One element, so that what placed() names several times is made once.
    return F.when(F.rlike(text, F.lit(pattern)), F.flatten(F.transform(F.array(pairs), placed))).otherwise(none)


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span meets one of others, which are sorted and do not overlap: the last one that begins before its end decides."""
    n = F.size(others)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        ahead = (acc["low"] < acc["high"]) & (F.get(others, middle)["start"] < span["end"])
        return F.struct(F.when(ahead, middle + 1).otherwise(acc["low"]).alias("low"), F.when(ahead, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

    count = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda acc: acc["low"])
    return (n > 0) & F.coalesce(F.get(others, count - 1)["end"] > span["start"], F.lit(False))


def kind_spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, order, kind, end, value>> of a kind."""
    return F.transform(spans(text, pattern), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """The spans of the three fixed kinds, those that are too short dropped."""
    value = lambda s: F.regexp_replace(s["value"], "^" + ASSIGN[: ASSIGN.index(")([") + 1], "")
    assign = F.filter(kind_spans(text, "assign", ASSIGN), lambda s: F.length(value(s)) >= VALUE)
    return assign, kind_spans(text, "access", ACCESS), kind_spans(text, "hex", HEX)


def transitions(samples: DataFrame, label: str, text: str) -> DataFrame:
    """(label, pair, n): how often each pair of neighbouring characters occurs; at most len(ALPHABET) ** 2 rows a label."""
    word = F.col(text)
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    return samples.where(F.length(word) > 1).select(label, F.explode(pairs).alias("pair")).groupBy(label, "pair").agg(F.count(F.lit(1)).alias("n"))


def smallest_keys(keys: DataFrame, take: int) -> list[int]:
    """The `take` smallest distinct k (at least 0), or all where there are fewer.

    Keys are spread evenly, so a limit that follows from their count lets little more than `take` through to the driver; where
    repeated keys leave too few, the limit rises.
    """
    n, expected = keys.count(), take + 8 * math.isqrt(take) + 32
    while True:
        limit = min(2**63 - 1, 2**63 * expected // max(n, 1))
        got = sorted(r["k"] for r in keys.where(F.col("k") <= limit).distinct().collect())
        if len(got) >= take or limit == 2**63 - 1:
            return got[:take]
        expected *= 4


def labelled_samples(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCS, seeded: int = SEEDED) -> DataFrame:
    """(random, word): values of the fixed patterns in the sampled documents and seeded strings; long ordinary words.

    The sample is the `documents` distinct rows with the smallest hashes of id and text.
    """
    key, t = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64(whole(text))), 1), whole(text).alias("t")
    chosen = docs.sparkSession.createDataFrame([(k,) for k in smallest_keys(docs.select(key.alias("k")), documents)], "k bigint")
    sample = checkpointed(docs.select(key.alias("k"), t).join(F.broadcast(chosen), "k", "left_semi").dropDuplicates(["k"]).select("t"))
    named = sample.select("t", F.concat(*base_spans(F.col("t"))).alias("base"))
    values = named.select(F.explode("base.value").alias("v")).select(F.explode(F.regexp_extract_all("v", F.lit("[A-Za-z0-9+/_=-]{12,}$"), F.lit(0))).alias("word"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = named.select(F.explode(F.regexp_extract_all(plain, F.lit(f"[A-Za-z0-9+/_=-]{{{ORDINARY},}}"), F.lit(0))).alias("word")).where(F.rlike("word", F.lit("[A-Za-z]")))  # numbers are no identifiers
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(seeded).select(F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, F.substring(F.base64(F.unhex(digest)), 1, 40)).otherwise(F.substring(F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), 1, 20)).alias("word"))
    return values.unionByName(made).withColumn("random", F.lit(1)).unionByName(ordinary.withColumn("random", F.lit(0)))


class Models:
    """Log-likelihood ratios of transitions (random over ordinary, add-one smoothed) and the deciding threshold."""

    def __init__(self, counts: dict[tuple[int, str], int]):
        rows = {k: [sum(counts.get((r, k + c), 0) for c in ALPHABET) for r in (0, 1)] for k in ALPHABET}
        self.size = len(ALPHABET)
        self.ratios = {a + b: round(math.log((counts.get((1, a + b), 0) + 1) / (rows[a][1] + self.size)) - math.log((counts.get((0, a + b), 0) + 1) / (rows[a][0] + self.size)), 4) for a in ALPHABET for b in ALPHABET}
        self.threshold = 0.0

    def table(self) -> Column:
        """The ratios as one literal array, by 67 * place of the first character + place of the second."""
        return F.from_json(F.lit("[" + ",".join(str(self.ratios[a + b]) for a in ALPHABET for b in ALPHABET) + "]"), "array<double>")

    def score(self, word: Column, ratios: Column) -> Column:
        """Mean log-likelihood ratio of a word's transitions, in one walk over its characters."""
        start = F.struct(F.lit(None).cast("int").alias("place"), F.lit(0.0).alias("sum"))

        def step(acc: Column, c: Column) -> Column:
            place = F.instr(F.lit(ALPHABET), c) - 1
            return F.struct(place.alias("place"), (acc["sum"] + F.coalesce(F.get(ratios, acc["place"] * self.size + place), F.lit(0.0))).alias("sum"))

        return F.aggregate(F.split(word, ""), start, step, lambda acc: acc["sum"]) / (F.length(word) - 1)


def train(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCS, seeded: int = SEEDED, let_through: float = LET_THROUGH) -> Models:
    samples = labelled_samples(docs, text, documents, seeded)
    models = Models({(r["random"], r["pair"]): r["n"] for r in transitions(samples, "random", "word").collect()})
    ratios = models.table()
    scored = samples.where((F.col("random") == 0) & (F.length("word") >= 12)).select(models.score(F.col("word"), ratios).alias("s"))
    row = scored.agg(F.percentile_approx("s", 1 - let_through, 100_000).alias("q")).first()
    models.threshold = max(row["q"] if row["q"] is not None else 0.0, 0.0) + 0.25
    return models


def scan_secrets(docs: DataFrame, models: Models | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Spans read kind:start:end in code points with the end exclusive, by start and then kind. Spans of the models (markov)
    never overlap one of the fixed patterns. Null texts count as empty: no spans, and the digest of nothing. Rows that repeat
    each give a row, null ids too. Words are never shortened, however long the text: time grows with the length of words, and with
    the 1.5th power of the matches of a text at most. Other columns are not read. An empty table gives no rows.
    """
    models = models or train(docs, text)
    t = F.col("t")
    kinds = ("assign", "access", "hex")
    rows = docs.select("doc_id", whole(text).alias("t")).select("doc_id", "t", *[c.alias(k) for c, k in zip(base_spans(t), kinds, strict=True)])
    rows = rows.select("*", F.array_sort(F.concat(*kinds)).alias("base"), kind_spans(t, "markov", CANDIDATE).alias("candidates"))
    free = lambda c: ~(overlaps(c, F.col("assign")) | overlaps(c, F.col("access")) | overlaps(c, F.col("hex")))
    ratios = models.table()
    random = lambda c: F.rlike(c["value"], F.lit("[A-Za-z]")) & (models.score(c["value"], ratios) > models.threshold)
    rows = rows.withColumn("markov", F.filter(F.filter("candidates", free), random))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "markov"))).alias("spans"), count("markov"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
