"""Near duplicates by b-bit MinHash.

Each document becomes 128 minima of its shingles' hashes. Bands of four whole minima give bucket keys; of each minimum only
the low four bits are kept and packed, eight 64-bit words for a document. Buckets link their members to two pivots, the smallest
id and the member that is nearest to most; what the packed signatures say about a pair (share of equal low bits, corrected for
chance collisions) drops pairs that are far below the threshold; the others are confirmed on their full sets. Members of one
component need no further comparison, so a large group of copies costs a few pairs for each member.

Buckets whose members still lie in different components are open. Their members meet once more in an exact join on prefixes of
their sets: shingles are ordered by how often open members have them, and two sets that reach the threshold share one of their
first few shingles, at places and sizes that leave room for the overlap. What members of a group have in common stands behind
what each has of its own, and a histogram of what a set shares bounds the overlap of each pair before it becomes a row, so a
large group makes few rows, linked or not; no bucket has a cap and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, fresh, python_ready, table

MINIMA, ROWS, BITS, SEED = 128, 4, 4, 20240613
#: A pair whose estimate lies this far below the threshold is dropped: six standard errors of 128 minima at 0.85, 5.4 at 0.8.
SLACK = 0.2
#: Counters of the table that finds very frequent shingles: 2 MB, whatever the input. Shingles that may occur more often than EXACT
#: times, beside what a counter has by chance, are ordered by their counters, the others by how often they occur.
COUNTERS, EXACT = 1 << 18, 1000
#: Sizes of sets are classed by steps of about one in CLASSES.
CLASSES = 50
#: Classes of a set's histogram, counts in a 64-bit word (the eighth byte stays free, so that no sum leaves the word), and items at most.
HISTOGRAM, PER_WORD, COUNTED = 63, 7, 6400
#: Pairs of one set that a task confirms at most, about.
PER_SET = 4096
#: Hashes of words that a Python worker keeps, some tens of MB; then the memory is emptied.
REMEMBERED = 150_000
_MASK = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    Words are runs of bytes other than blank and \\x09-\\x0D after A-Z are lower-cased. A text of fewer words is one shingle;
    a text without words has none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """Two halves of a digest of the whole set."""
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return digest & _MASK, digest >> 64


def _family(minima: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, minima, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, minima, np.uint64)


def minima_of(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash function the smallest 32-bit value over the set, which has at least one element."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), 1024):
            np.minimum(least, ((hashes[lo : lo + 1024, None] * a + b) >> np.uint64(32)).min(axis=0), out=least)
    return least


SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>"


def signatures(docs: DataFrame, words: int, text: str = "text", seed: int = SEED) -> DataFrame:
    """Rows of SIGNATURES, in one pass over the texts; set_a and set_b identify the whole set."""
    python_ready(docs.sparkSession)
    a, b = _family(MINIMA, seed)
    mix, _ = _family(MINIMA, seed + 1)
    per_word = 64 // BITS
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, ids_a, ids_b, bands, packed = [], [], [], [], []
                with np.errstate(over="ignore"):
                    for text_ in part.column(1).to_pylist():
                        h = shingle_hashes(text_, words)
                        sizes.append(len(h))
                        one, two = set_ids(h)
                        ids_a.append(one)
                        ids_b.append(two)
                        if len(h):
                            m = minima_of(h, a, b)
                            key = ((m + np.uint64(1)) * mix).reshape(-1, ROWS)
                            key ^= key >> np.uint64(31)
                            key = (key * mix.reshape(-1, ROWS)).sum(axis=1, dtype=np.uint64)
                            bands.append((key ^ (key >> np.uint64(32))).view(np.int64))
                            low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, per_word)
                            packed.append((low << shifts).sum(axis=1, dtype=np.uint64).view(np.int64))
                        else:
                            bands.append([])
                            packed.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(ids_a, np.uint64).view(np.int64)), pa.array(np.array(ids_b, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, SIGNATURES)


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed signatures: equal low bits, counted by words and corrected for collisions by chance."""
    ones = sum(1 << s for s in range(0, 64, BITS))
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        v = x[i].bitwiseXOR(y[i])
        low = v
        for s in range(1, BITS):
            low = low.bitwiseOR(F.shiftrightunsigned(v, s))
        differ = differ + F.bit_count(low.bitwiseAND(F.lit(ones if ones < 1 << 63 else ones - (1 << 64))))
    equal, chance = F.lit(1.0) - differ / F.lit(float(MINIMA)), 1.0 / (1 << BITS)
    return (equal - chance) / (1.0 - chance)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch's rows whose text, the last column, has the set that set_a, the second, names: not another text of a repeated id."""
    for lo in range(0, batch.num_rows, 256):
        part = batch.slice(lo, 256)
        for i, (a, t) in enumerate(zip(part.column(1).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True), lo):
            h = shingle_hashes(t, words)
            if set_ids(h)[0] == a & _MASK:
                yield i, h


def texts_of(docs: DataFrame, named: DataFrame, text: str = "text") -> DataFrame:
    """named, materialised rows (id, set_a, ...), with the texts of their ids in the last column."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("text"))
    return chosen.join(broadcast_if_few(named), "id").select(*named.columns, "text")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, items) of texts (id, set_a, ..., text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = list(_sets(part, words))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in sets], pa.int64())), pa.array([h.view(np.int64) for _, h in sets], pa.list_(pa.int64()))], names=["id", "items"])

    return checkpointed(texts.mapInArrow(run, "id bigint, items array<bigint>"))


def confirmed(pairs: DataFrame, sets: DataFrame, hundredths: int, per_set: int = PER_SET) -> DataFrame:
    """Of pairs (a, b) of ids, materialised, those whose full sets reach the threshold.

    b's set travels to a's, so the set of a pivot, which has many pairs, is not copied into a shuffle for each of them; it is
    copied for every per_set pairs that it has, which spreads them over tasks.
    """
    many = checkpointed(pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count(F.lit(1)) / per_set).cast("int").alias("parts")).where("parts > 1"))
    spread = lambda df: df.join(broadcast_if_few(many), F.col("a") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("of")
    left = spread(sets.select(F.col("id").alias("a"), F.col("items").alias("x"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    dealt = spread(pairs).withColumn("salt", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    joined = dealt.join(right, "b").join(left, ["a", "salt"]).select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return checkpointed(joined.where(F.col("both") * 100 >= hundredths * (F.col("sum") - F.col("both"))).select("a", "b"))


def shingle_counts(texts: DataFrame, words: int, counters: int = COUNTERS) -> np.ndarray:
    """How often shingles of texts (id, set_a, ..., text) fall on each counter; as many rows as counters reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            for _, h in _sets(batch, words):
                np.add.at(counts, h.view(np.int64) % counters, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    rows = texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(counters, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"]
    return out


def _field(hist: str, i: int) -> str:
    """The i-th count of a histogram, in SQL."""
    return f"(shiftrightunsigned({hist}[{i // PER_WORD}], {8 * (i % PER_WORD)}) & 255)"


#: The sum of the smaller counts of two histograms, in SQL.
_SMALLER = " + ".join(f"least({_field('s.hist', i)}, {_field('l.hist', i)})" for i in range(HISTOGRAM))


def histogram(shared: Column) -> Column:
    """How many items of (often, item) fall in each class of their remainders, a byte for each; null where a count does not fit."""

    def word(w: int) -> Column:
        def add(total: Column, x: Column) -> Column:
            i = F.pmod(x["item"], F.lit(HISTOGRAM))
            one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % PER_WORD * 8).cast("int"))
            return total + F.when(F.floor(i / PER_WORD) == w, one).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(shared, F.lit(0).cast("bigint"), add)

    # A count beyond a byte runs over into the next, so that the counts no longer sum up to the items.
    count = lambda h: sum((F.shiftrightunsigned(h[i // PER_WORD], 8 * (i % PER_WORD)).bitwiseAND(F.lit(255)) for i in range(HISTOGRAM)), F.lit(0))
    made = F.array(F.array(*[word(w) for w in range(HISTOGRAM // PER_WORD)]))
    return F.when(F.size(shared) <= COUNTED, F.try_element_at(F.filter(made, lambda h: count(h) == F.size(shared)), F.lit(1)))


def prefix_pairs(texts: DataFrame, counts: np.ndarray, words: int, hundredths: int, exact: int = EXACT) -> DataFrame:
    """Pairs (a, b) of texts (id, set_a, root, asked, text) of different roots, one of them asked, whose sets may reach the threshold.

    All that reach it are among them. With t the threshold, sets of n <= m items must share o = t (n + m) / (1 + t) at least, so
    n >= t m, and in a common order of all items the first one that they share stands at places (from 0) with o items from there
    to either end. Each set offers the items that can be such a first one: as the smaller set of a pair under its own size class,
    as the larger under the classes of the sizes that its place leaves possible. The order is rarest first: items that no other
    set has come first and are not offered. How often an item occurs is counted where its counter is small; elsewhere the counter
    itself, which is never less, takes its place. Of the items that a set has in common with any other, each set also offers how
    many fall in each of some classes: the sum of the smaller counts of a pair is never less than what it shares.
    """
    t, size = hundredths, len(counts)
    bound = exact + 4 * -(-int(counts.sum()) // size)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                x = np.concatenate([np.empty(0, np.int64), *(h.view(np.int64) for _, h in _sets(batch.slice(lo, 256), words))])
                c = counts[x % size]
                yield pa.RecordBatch.from_arrays([pa.array(x[(c > 1) & (c <= bound)])], names=["of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, ns, items, often = [], [], [], []
                for row, h in _sets(part, words):
                    x = h.view(np.int64)
                    c = counts[x % size]
                    rows.append(row)
                    ns.append(len(x))
                    items.append(x[c > 1])
                    often.append(np.where(c > bound, c, 0)[c > 1])
                taken = part.select(["id", "set_a", "root", "asked"]).take(pa.array(rows, pa.int64()))
                lists = (pa.array(c, pa.list_(pa.int64())) for c in (items, often))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ns, pa.int64()), *lists], names=["id", "set_a", "root", "asked", "n", "item", "often"])

    made = texts.mapInArrow(run, "id bigint, set_a bigint, root bigint, asked boolean, n bigint, item array<bigint>, often array<bigint>")
    rows = made.select("id", "set_a", "root", "asked", "n", F.inline(F.arrays_zip("item", "often")))
    some = texts.mapInArrow(found, "of bigint").groupBy("of").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    key = F.when(F.col("often") == 0, F.col("item")).otherwise(F.xxhash64("item", "id", "set_a"))  # rows of very frequent items stay apart
    counted = rows.withColumn("key", key).join(some, (F.col("key") == F.col("of")) & (F.col("often") == 0), "left")
    counted = counted.withColumn("often", F.when(F.col("often") > 0, F.col("often")).otherwise(F.coalesce("times", F.lit(1))))
    shared = counted.where("often > 1").groupBy("id", "set_a", "root", "asked", "n").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("shared"))
    before = F.col("n") - F.size("shared")
    shared = shared.withColumn("hist", histogram(F.col("shared")))
    first = F.slice("shared", F.lit(1), F.greatest(F.col("n") - F.ceil(t * F.col("n") / 100) + 1 - before, F.lit(0)).cast("int"))
    offers = shared.select("id", "root", "asked", "n", before.alias("before"), "hist", F.posexplode(first).alias("i", "x"))
    offers = checkpointed(offers.select("id", "root", "asked", "n", "hist", F.col("x.item").alias("item"), (F.col("before") + F.col("i")).alias("at")))
    step = lambda n: F.floor(F.log(n) * CLASSES).cast("int")
    left = F.col("n") - F.col("at")  # items from there to the end
    small = offers.where((100 + t) * left >= 2 * t * F.col("n")).withColumn("class", step(F.col("n")))
    least, most = F.ceil(t * F.col("n") / 100), F.least(F.col("n"), F.floor((100 + t) * left / t) - F.col("n"))
    large = offers.withColumn("class", F.explode(F.sequence(step(least), step(most))))
    met = F.expr(
        "s.item = l.item and s.class = l.class and s.root <> l.root and (s.asked or l.asked) and (s.n < l.n or s.n = l.n and s.id < l.id) "
        f"and 100 * s.n >= {t} * l.n and {100 + t} * (s.n - s.at) >= {t} * (s.n + l.n) and {100 + t} * (l.n - l.at) >= {t} * (s.n + l.n) "
        f"and (s.hist is null or l.hist is null or {100 + t} * ({_SMALLER}) >= {t} * (s.n + l.n))"
    )
    return checkpointed(small.alias("s").join(large.alias("l"), met).select(F.least("s.id", "l.id").alias("a"), F.greatest("s.id", "l.id").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id that has a link, root being the smallest id reachable.

    Alternating large and small stars: each round hangs every id on smaller ones, and a few rounds leave stars. Rows stay in
    the cluster; each round is checkpointed.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(mark):
            break
        mark = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return checkpointed(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots))


def bucket_pivots(rows: DataFrame) -> DataFrame:
    """(key, pivots): of each bucket (key, id) with several members the smallest id, and the member that is nearest to most.

    A member that changed little has its minima in common with many others, so the sum of its buckets' sizes tells how many it is
    likely to be linked with; the largest sum makes a pivot.
    """
    sizes = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("p")).where("n > 1"))
    near = rows.join(sizes.where("n > 2").select("key", "n"), "key")  # two members are linked by the first of them
    mass = checkpointed(near.groupBy("id").agg(F.sum("n").alias("mass")))
    hubs = near.join(broadcast_if_few(mass), "id").groupBy("key").agg(F.max_by("id", F.struct("mass", F.xxhash64("id"))).alias("q"))
    return checkpointed(sizes.join(hubs, "key", "left").select("key", F.array_distinct(F.array("p", F.coalesce("q", "p"))).alias("pivots")))


def near_groups(docs: DataFrame, words: int = 5, hundredths: int = 80, text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= hundredths * |A or B|; component_id is the smallest doc_id reachable, and kept
    says that it is the document's own. Documents without words (null, empty or blank text) stand alone; long texts count whole.
    Rows that repeat an id belong where their own texts do, and texts whose smallest id is the same are linked; a null doc_id
    stands alone, with null as component_id, and is kept. The share of links that no band catches is below 1e-9 at 0.85 and 1e-7
    at 0.8, and of links at the threshold that the signatures' estimate drops 1.9e-8 and 2.0e-7. An empty table gives no rows.
    """
    signed = checkpointed(signatures(docs, words, text, seed))
    some = signed.where("doc_id is not null and n_shingles > 0")
    classes = checkpointed(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    reps = checkpointed(some.dropDuplicates(["doc_id", "set_a", "set_b"]).join(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["doc_id", "set_a", "set_b"], "left_semi").select(F.col("doc_id").alias("id"), "set_a", "bands", "packed"))
    rows = reps.select("id", F.explode("bands").alias("key"))
    pivots = bucket_pivots(rows)
    met = rows.join(pivots, "key").select("id", F.explode("pivots").alias("pivot")).where("id <> pivot")
    stars = met.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    likely = _likely(stars, reps, hundredths)
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets_of = lambda ids: shingle_sets(texts_of(docs, checkpointed(reps.select("id", "set_a").join(ids, "id", "left_semi")), text), words)
    roots = components(confirmed(likely, sets_of(ends(likely)), hundredths))
    placed = reps.join(roots, "id", "left").select("id", "set_a", F.coalesce("root", "id").alias("root"), "bands")
    spread = placed.select("id", "set_a", "root", F.explode("bands").alias("key")).join(pivots.select("key"), "key", "left_semi")
    counted = spread.groupBy("key", "root").count()
    mixed = counted.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    asked = F.max(F.col("root") != F.col("main")).alias("asked")  # pairs outside the largest component of each open bucket
    open_ = checkpointed(spread.join(mixed.select("key", "main"), "key").groupBy("id", "set_a", "root").agg(asked))
    texts = texts_of(docs, open_.select("id", "set_a", "root", "asked"), text)
    pairs = prefix_pairs(texts, shingle_counts(texts, words), words, hundredths)
    more = confirmed(pairs, sets_of(ends(pairs)), hundredths)
    roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    of_class = checkpointed(classes.join(roots, classes.rep == roots.id, "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("class_root")))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_root")).otherwise(F.col("doc_id"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _likely(pairs: DataFrame, reps: DataFrame, hundredths: int) -> DataFrame:
    left = reps.select(F.col("id").alias("a"), F.col("packed").alias("x"))
    right = reps.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return checkpointed(pairs.join(left, "a").join(right, "b").where(estimate(F.col("x"), F.col("y")) >= hundredths / 100 - SLACK).select("a", "b"))


def drop_near(docs: DataFrame, words: int = 5, hundredths: int = 80, text: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows that repeat an id go together. A null doc_id stays.

    Texts are shuffled only where many ids go.
    """
    gone, = fresh(docs, "gone")
    dropped = checkpointed(near_groups(docs, words, hundredths, text).where("not kept").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(broadcast_if_few(dropped), docs["doc_id"] == dropped[gone], "left_anti")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, hundredths=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
