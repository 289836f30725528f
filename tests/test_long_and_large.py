"""Operators for what does not fit a task: drawn few-shot prompts and blocks, endless samples, long brackets, large systems, sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.errors import InvalidParams
from frameloom.functions import frames as X
from frameloom.functions.permute import permuted
from frameloom.operators import brackets as B, corpus as C, ranged, stats as S
from frameloom.operators.processors import chain


# ---- permutations and few-shot prompts ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 63, 64, 65, 1000])
def test_every_key_permutes(spark, n):
    rows = spark.range(3 * n).select((F.col("id") % 3).alias("key"), F.floor(F.col("id") / 3).alias("id"))
    got = rows.select("key", permuted(F.col("id"), F.lit(n).cast("bigint"), F.col("key").cast("string")).alias("y")).collect()
    for key in range(3):
        assert sorted(r.y for r in got if r.key == key) == list(range(n))


def test_keys_permute_otherwise_and_evenly(spark):
    n, keys = 8, 8000
    got = spark.range(keys).select(permuted(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"), F.col("id").cast("string")).alias("y")).collect()
    counts = Counter(r.y for r in got)
    assert sum((counts[i] - keys / n) ** 2 / (keys / n) for i in range(n)) < 24.3  # chi-square of 7 degrees, 0.001
    assert spark.range(1).select(permuted(F.lit(9).cast("bigint"), F.lit(8).cast("bigint"), F.lit("k")).alias("y")).first().y is None


def pool_of(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_the_whole_pool_is_served(spark):
    n, shots = 5000, 3
    pool = pool_of(spark, n)
    rows = C.few_shot(pool, pool, "k", shots, 4).collect()
    assert len(rows) == n and all(len(set(r.shots)) == shots and f"p{r.k}" not in r.shots for r in rows)
    served = Counter(p for r in rows for p in r.shots)
    assert len(served) > 0.93 * n  # 1 - exp(-3) = 0.95 of the rows are drawn at least once
    assert len({tuple(r.shots) for r in rows}) > 0.999 * n
    tens = Counter(int(p[1:]) * 50 // n for p in served.elements())
    assert sum((tens[i] - n * shots / 50) ** 2 / (n * shots / 50) for i in range(50)) < 85.4  # chi-square of 49 degrees, 0.001
    again = {r.k: r.shots for r in C.few_shot(pool.repartition(3), pool.repartition(5), "k", shots, 4).collect()}
    assert again == {r.k: r.shots for r in rows}


def test_few_shot_of_small_and_odd_pools(spark):
    items = spark.createDataFrame([(0,), (1,), (77,), (77,), (None,)], "k long")
    got = sorted(((r.k, sorted(r.shots)) for r in C.few_shot(items, pool_of(spark, 3), "k", 5, 1).collect()), key=repr)
    assert got == sorted([(0, ["p1", "p2"]), (1, ["p0", "p2"]), (77, ["p0", "p1", "p2"]), (77, ["p0", "p1", "p2"]), (None, [])], key=repr)
    assert [r.shots for r in C.few_shot(items, pool_of(spark, 0), "k", 2, 1).collect()] == [[]] * 5
    assert [r.shots for r in C.few_shot(items, pool_of(spark, 9), "k", 0, 1).collect()] == [[]] * 5
    assert C.few_shot(items.limit(0), pool_of(spark, 3), "k", 2, 1).collect() == []
    with pytest.raises(ValueError, match="rise"):
        C.few_shot(items, pool_of(spark, 3), "k", (3, 2), 1)


def test_few_shot_by_subset_with_drawn_numbers_and_fixed_prompts(spark):
    pool = pool_of(spark, 900).withColumn("s", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("k") % 3 + 1).cast("int")))
    items = pool.select("k", "s").unionByName(spark.createDataFrame([(1000, None), (1001, "zzz"), (None, "a")], "k long, s string"))
    fixed = spark.createDataFrame([("c", ["x", "y"])], "s string, prompts array<string>")
    rows = C.few_shot(items, pool, "k", (1, 3), 2, "s", fixed).collect()
    assert len(rows) == 903
    numbers = Counter()
    for r in rows:
        if r.s == "c":
            assert r.shots == ["x", "y"]
        elif r.k is None or r.k >= 1000:
            assert r.shots == []
        else:
            numbers[len(r.shots)] += 1
            assert all(int(p[1:]) % 3 == r.k % 3 and int(p[1:]) != r.k for p in r.shots)
    assert set(numbers) == {1, 2, 3} and min(numbers.values()) > 150


def test_dense_positions_by_group(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("xyz")) for k in rng.sample(range(10_000), 500)]
    got = C.dense_positions(spark.createDataFrame(rows, "k long, g string"), "k", ("g",), bucket=16).collect()
    for g in "xyz":
        assert [r.position for r in sorted(r for r in got if r.g == g)] == list(range(sum(x == g for _, x in rows)))


def test_ranges_grow_with_the_square_root():
    assert C.range_count(0) == 0 and C.range_count(4096) == 1 and C.range_count(4097) == 2
    assert C.range_count(10**10) == 10**5 and C.range_count(10**12) == 10**6


def test_shuffled_places(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    want = {r.k: i for i, r in enumerate(C.shuffled(rows, 5, "k").collect(), 1)}
    assert {r.k: r.place for r in C.shuffled_places(rows, 5, "k", bucket=100).collect()} == want


# ---- drawn blocks ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("held", [1, 1_000_000])
def test_drawn_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    rng = random.Random(7)
    texts = {i: "".join(rng.choices("abc", k=rng.choice([0, 3, 40, 500]))) for i in range(200)}
    stream = [x for i in range(200) for x in [*map(ord, texts[i]), 0]]
    docs = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "i long, t string")
    rows = C.drawn_blocks(docs, "i", X.points_of(F.col("t")), F.length("t"), 0, 64, 10, 3).collect()
    assert len({r.block for r in rows}) == 10
    assert all(r.tokens == stream[r.block * 64 : r.block * 64 + 64] for r in rows)
    everything = C.drawn_blocks(docs, "i", X.points_of(F.col("t")), F.length("t"), 0, 64, 10**6, 3).collect()
    assert sorted(r.block for r in everything) == list(range(len(stream) // 64))
    other = C.drawn_blocks(docs, "i", X.points_of(F.col("t")), F.length("t"), 0, 64, 10, 4).collect()
    assert {r.block for r in other} != {r.block for r in rows}
    assert C.drawn_blocks(docs.limit(0), "i", X.points_of(F.col("t")), F.length("t"), 0, 64, 10, 3).collect() == []


def test_only_documents_in_drawn_blocks_become_tokens(spark):
    docs = spark.range(400).select(F.col("id").alias("i"), F.repeat(F.lit("ab"), 50).alias("t"))
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<bigint>")
    def tokens(t):
        made.add(1)
        return list(map(ord, t))

    assert len(C.drawn_blocks(docs, "i", tokens(F.col("t")), F.length("t"), 0, 101, 3, 1).collect()) == 3
    assert made.value == 3  # a block is a document with its end here


# ---- endless samples ---------------------------------------------------------------------------------------------------------
def long_frames(spark, n, kind="bigint", samples=2):
    cell = ((F.col("id") * 7919) % 13 % 4).cast(kind)
    return spark.range(n).select(F.lit("t").alias("task"), F.lit(0).alias("shard_id"), F.when(F.col("id") % samples > 0, F.col("id") % samples).alias("sample_id"), F.floor(F.col("id") / samples).alias("pos"), F.col("id").alias("step_index"), F.array(cell, cell).alias("state"), F.lit(None).cast("string").alias("label"))


CHAINS = [
    [("dedup", {})], [("diff_encoder", {})], [("clip_stitcher", {"max_len": 7, "insert_separator": True})], [("sequence_stitcher", {"frames_per_sequence": 9})],
    [("batch_collector", {"batch_size": 4, "num_frames": 3})], [("dedup", {}), ("diff_encoder", {}), ("clip_stitcher", {"max_len": 5, "insert_separator": True}), ("sequence_stitcher", {"frames_per_sequence": 6})],
]


@pytest.mark.parametrize("steps", CHAINS, ids=lambda s: "+".join(n for n, _ in s))
@pytest.mark.parametrize("per_range", [1, 10, 1000])
def test_ranges_give_the_same_frames(spark, steps, per_range):
    frames = long_frames(spark, 301)
    key = lambda r: (r.sample_id or 0, r.pos, repr(r))
    assert sorted(chain(frames, steps, per_range).collect(), key=key) == sorted(chain(frames, steps).collect(), key=key)


def test_ranges_normalise_alike(spark):
    frames, steps = long_frames(spark, 200, "double", 3), [("normalizer", {"max_val": 9}), ("dedup", {"min_entropy": 0.0})]
    key = lambda r: (r.sample_id or 0, r.pos)
    assert sorted(chain(frames, steps, 16).collect(), key=key) == sorted(chain(frames, steps).collect(), key=key)
    with pytest.raises(InvalidParams):
        chain(frames, steps, 0)


def test_one_endless_sample_spreads_over_tasks(spark):
    n, ranges = 5_000_000, 50
    frames = long_frames(spark, n, samples=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told = ranged.with_before(frames, "before", n // ranges)
        sizes = [r.n for r in told.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[2]
    assert told.where("before is null").count() == 1
    before = ((F.col("step_index") - 1) * 7919) % 13 % 4
    assert told.where((F.col("pos") > 0) & (F.element_at("before", 1) != before)).count() == 0


# ---- brackets ----------------------------------------------------------------------------------------------------------------
def words(rng, symbols, n):
    out, open_ = [], []
    while len(out) < n:
        if open_ and rng.random() < 0.5:
            out.append(open_.pop() + symbols)
        else:
            open_.append(rng.randrange(symbols))
            out.append(open_[-1])
    return out + [s + symbols for s in reversed(open_)]


@pytest.mark.parametrize("per_range, fan", [(1, 2), (4, 3), (1000, 16)])
def test_brackets_of_any_length(spark, per_range, fan):
    rng = random.Random(3)
    seqs = {0: [], 1: [0, 2], 2: [2, 0], 3: [0, 3], 4: [0, 1, 2, 3], 5: [0, 7], 6: [2, 3, 0], 7: [0, 0, 0], 8: [-1]}
    for i in range(9, 40):
        w = words(rng, 2, rng.randrange(60))
        if i % 3 == 0 and w:
            w[rng.randrange(len(w))] = rng.randrange(4)
        seqs[i] = w
    rows = spark.createDataFrame([(i, p, t) for i, s in seqs.items() for p, t in enumerate(s)], "q long, p long, t long").repartition(5)
    arrays = spark.createDataFrame([(i, s) for i, s in seqs.items() if s], "q long, s array<long>")
    want = {r.q: (r.d, r.c) for r in arrays.select("q", X.dyck_valid(F.col("s"), 2).alias("d"), X.shuffle_dyck_valid(F.col("s"), 2).alias("c")).collect()}
    nested = {r.q: r for r in B.nested_validity(rows, "q", "p", "t", 2, per_range, fan).collect()}
    counted = {r.q: r for r in B.counted_validity(rows, "q", "p", "t", 2, per_range, fan).collect()}
    assert {q: (nested[q].valid, counted[q].valid) for q in nested} == want
    assert {q: nested[q].n for q in nested} == {q: len(s) for q, s in seqs.items() if s}
    assert (nested[6].unopened, nested[6].unclosed) == (2, 1) and (nested[7].unopened, nested[7].unclosed) == (0, 3)
    assert nested[3].unopened is None and nested[3].unclosed is None
    assert B.nested_validity(rows.limit(0), "q", "p", "t", 2).collect() == []


def test_a_sequence_longer_than_a_row_should_be(spark):
    n = 400_000
    pairs = spark.range(n).select(F.lit(1).alias("q"), "id", F.when(F.col("id") % 4 < 2, F.col("id") % 2).otherwise(F.when(F.col("id") % 4 == 2, 3).otherwise(2)).alias("t"))
    assert B.nested_validity(pairs, "q", "id", "t", 2).collect() == [(1, n, True, 0, 0)]


# ---- pairs and sketches ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("per_block", [1, 7, 1024])
def test_pairs_in_blocks(spark, per_block):
    rows = [(g, i, float(i)) for g, n in ((0, 40), (1, 3), (2, 1)) for i in range(100 * g, 100 * g + n)] + [(None, 999, 1.0)]
    df = spark.createDataFrame(rows, "g int, i long, x double")
    got = S.pairwise(df, ["g"], "i", per_block).select("a.i", "b.i", "a.x", "b.x").collect()
    assert sorted(map(tuple, got)) == sorted((a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] != b[1])


def test_pairs_of_one_system_spread(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), "id")
    pairs = S.pairwise(df, ["g"], "id", 50)  # 20 x 20 blocks
    sizes = [r.n for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 * 999 and max(sizes) < 2 * sum(sizes) / spark.sparkContext.defaultParallelism


def test_sketches_unite(spark):
    frames = spark.range(40_000).select(F.lit("t").alias("task"), (F.col("id") % 8).cast("int").alias("shard_id"), F.col("id").alias("sample_id"), F.lit(0).cast("bigint").alias("pos"), F.array(F.col("id") % 9000).alias("state"))
    sketches = S.state_sketches(frames, ["task"])
    assert sketches.count() == 8 and all(len(r.sketch) < 5000 for r in sketches.collect())
    row = S.sketched_diversity(sketches, ["task"]).first()
    assert abs(row.patterns - 9000) <= 3 * 1.04 / 64 * 9000 and row.diversity == row.patterns / 40_000
    more = S.sketched_diversity(sketches.unionByName(sketches), ["task"]).first()
    assert more.patterns == row.patterns  # merging what is there already changes nothing
