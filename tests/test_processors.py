import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.errors import InvalidParams
from frameloom.functions import frames as X
from frameloom.model import KINDS, schema
from frameloom.operators.processors import PROCESSORS, chain, rewritten

# The cells, steps and tokens below are literal vectors that every implementation must give.


def frames(spark, kind, *states):
    return spark.createDataFrame([("t", 0, 0, i, i, s, None) for i, s in enumerate(states)], schema(kind))


def result(df):
    return [(r.step_index, list(r.state)) for r in df.orderBy("pos").collect()]


def ints(spark, *cells):
    return frames(spark, "int", *[c if isinstance(c, list) else [c] for c in cells])


def test_normalizer(spark):
    df = frames(spark, "float", [10.0], [20.0], [0.0])
    assert [s for _, s in result(chain(df, [("normalizer", {"max_val": 100})]))] == [[50], [100], [0]]
    df = frames(spark, "float", [1.0, 8.0])
    assert result(chain(df, [("normalizer", {"max_val": 100, "method": "LogBucket"})])) == [(0, [32, 100])]
    assert result(chain(frames(spark, "float", [3.0], [3.0]), [("normalizer", {})])) == [(0, [0]), (1, [0])]
    assert result(chain(frames(spark, "bool", [True, False]), [("normalizer", {})])) == [(0, [1, 0])]
    assert "Window" not in chain(df, [("normalizer", {"min": 0.0, "max": 1.0})])._jdf.queryExecution().optimizedPlan().toString()


def test_dedup(spark):
    keep = lambda df, **c: [s for s, _ in result(chain(df, [("dedup", c)]))]
    assert keep(ints(spark, 1, 1, 1, 2, 1)) == [0, 3, 4]
    assert keep(ints(spark, [0, 0], [1, 1], [0, 0]), remove_consecutive_duplicates=False) == [1]
    assert keep(ints(spark, [5] * 100, [1, 2, 3]), min_entropy=0.1) == [1]
    assert keep(ints(spark, [1, 2], [0, 0], [1, 2])) == [0]


@pytest.mark.parametrize(("cells", "entropy"), [([1, 2, 3], 0.1981203125901445), ([1, 1, 2, 2], 0.125), ([], 0.0), ([-1, 1, 255, -257], 0.1014)])
def test_entropy(spark, cells, entropy):
    got = ints(spark, cells).select(X.histogram_entropy(F.col("state"))).first()[0]
    assert got == pytest.approx(entropy, abs=1e-4)


def test_diff_encoder(spark):
    states = lambda df, **c: [s for _, s in result(chain(df, [("diff_encoder", c)]))]
    assert states(ints(spark, 10, 7, 15)) == [[10], [-3], [8]]
    assert states(frames(spark, "float", [10.0], [12.0])) == [[10.0], [2.0]]
    assert states(frames(spark, "bool", [True], [True], [False], [False])) == [[True], [False], [True], [False]]
    assert states(ints(spark, 5, 8), prepend_zero_frame=True) == [[5], [3]]
    assert states(ints(spark, [1, 2, 3], [5, 5])) == [[1, 2, 3], [4, 3]]


def test_token_mapper(spark):
    states = lambda df, **c: [s for _, s in result(chain(df, [("token_mapper", c)]))]
    assert states(frames(spark, "float", [0.0, 0.5])) == [[0x4E00, 0x4E00 + 128]]
    assert states(ints(spark, 1), insert_newline=True) == [[0x4E01, 10]]
    assert states(ints(spark, (1 << 63) - 1, -100000)) == [[0x10FFFF], [0]]


def test_clip_stitcher(spark):
    run = lambda n, **c: chain(ints(spark, *range(n)), [("clip_stitcher", c)]).orderBy("pos").collect()
    out = run(6, max_len=3, insert_separator=True)
    assert [(r.step_index, r.label) for r in out] == [(0, None), (1, None), (2, None), (0, "__SEPARATOR__"), (3, None), (4, None), (5, None)]
    assert [r.pos for r in out] == list(range(7)) and list(out[3].state) == []
    assert [r.step_index for r in run(3, max_len=1, insert_separator=True)] == [0, 0, 1, 1, 2]
    assert len(run(5, max_len=2)) == 5 and run(5, max_len=0, insert_separator=True) == []


def test_patch_tokenizer(spark):
    run = lambda cells, **c: [s for _, s in result(chain(ints(spark, cells), [("patch_tokenizer", {"patch": 2} | c)]))][0]
    assert run([5, 3, 1, 7], rows=2, cols=2) == [10000, 7135, 10001]
    assert run([1, 2, 3, 4, 5, 6, 7, 8], rows=2, cols=2, n_groups=2) == [10000, 7531, 8642, 10001]
    assert run([1, 2, 3, 4, 5, 6, 7, 8, 0, 1, 2, 3, 4, 5, 6, 7], rows=4, cols=4) == [10000, 6521, 8743, 5410, 7632, 10001]
    for bad in ({"rows": 3, "cols": 2}, {"rows": 2, "cols": 2, "num_colors": 1}, {"patch": 5, "rows": 5, "cols": 5}):
        with pytest.raises(InvalidParams):
            run([1] * 25, **bad)


def test_patches_decode(spark):
    cells = [(i * 7) % 4 for i in range(64)]
    df = chain(ints(spark, cells), [("patch_tokenizer", {"patch": 2, "rows": 8, "cols": 8, "num_colors": 4})])
    assert list(df.select(X.patch_cells(F.col("state"), 2, 8, 8, 4)).first()[0]) == cells


def test_stitching_keeps_all_tokens(spark):
    df = ints(spark, [100, 1, 101], [100, 2, 101], [100, 3, 101])
    run = lambda **c: [s for _, s in result(chain(df, [("sequence_stitcher", c)]))]
    assert run(frames_per_sequence=3) == [[100, 1, 101, 100, 2, 101, 100, 3, 101]]
    assert run(frames_per_sequence=2, add_start_token=True, start_token=1000, add_end_token=True, end_token=1001) == [[1000, 100, 1, 101, 100, 2, 101, 1001], [1000, 100, 3, 101, 1001]]
    with pytest.raises(InvalidParams):
        run(frames_per_sequence=0)


def test_batch_collector(spark):
    out = chain(ints(spark, 1, 2, 3, 4, 5, 6, 7), [("batch_collector", {"batch_size": 3, "num_frames": 2})]).orderBy("pos").collect()
    assert [(list(r.state), r.label, r.step_index) for r in out] == [([1, 2, 3, 4, 5, 6], "batch_data", 0), ([7], "batch_data", 0)]


def test_chain_of_four(spark):
    df = frames(spark, "float", [0.0], [0.25], [0.25], [0.5], [1.0], [1.0])
    out = chain(df, [("normalizer", {}), ("dedup", {}), ("diff_encoder", {}), ("token_mapper", {})])
    assert result(out) == [(1, [20032]), (3, [20032]), (4, [20095])]
    assert [r.pos for r in out.orderBy("pos").collect()] == [0, 1, 2]


def test_idle_steps_vanish_and_one_exchange_is_enough(spark):
    assert rewritten([("null", {}), ("clip_stitcher", {}), ("dedup", {})]) == [("dedup", {})]
    plan = chain(ints(spark, 1, 2), [("dedup", {}), ("diff_encoder", {}), ("token_mapper", {})])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_samples_do_not_mix(spark):
    rows = [("t", s, i, 0, 0, [5], None) for s in (0, 1) for i in (0, 1)]
    out = chain(spark.createDataFrame(rows, schema("int")), [("diff_encoder", {}), ("dedup", {})])
    assert out.count() == 4


def test_empty_input(spark):
    for name in PROCESSORS.names():
        config = {"patch": 1, "rows": 1, "cols": 1, "frames_per_sequence": 2, "batch_size": 1, "num_frames": 1, "max_len": 2, "insert_separator": True}
        assert chain(spark.createDataFrame([], schema("int")), [(name, config)]).count() == 0
    assert set(KINDS) == {"int", "float", "bool"}


def test_text_of_code_points(spark):
    df = ints(spark, [0x4E00, 65, 0xD800, -1, 0x1F642, 0x110000])
    assert df.select(X.text_of(F.col("state"))).first()[0] == "一A��🙂�"
    assert [r[0] for r in spark.createDataFrame([("aé🙂",), ("",)], "t string").select(X.points_of(F.col("t"))).collect()] == [[97, 233, 0x1F642], []]


def test_pass_at_k(spark):
    df = spark.createDataFrame([(10, 3), (0, 0), (5, 0)], "n int, c int")
    assert [round(r[0], 9) for r in df.select(X.pass_at_k(F.col("n"), F.col("c"), 1)).collect()] == [0.3, 1.0, 0.0]
    assert df.select(X.pass_at_k(F.col("n"), F.col("c"), 5)).first()[0] == pytest.approx(0.9166666666666666)


def test_brackets(spark):
    df = spark.createDataFrame([([0, 1, 3, 2],), ([0, 1, 2, 3],), ([2],), ([],)], "s array<bigint>")
    assert [tuple(r) for r in df.select(X.dyck_valid(F.col("s"), 2), X.shuffle_dyck_valid(F.col("s"), 2)).collect()] == [(True, True), (False, True), (False, False), (True, True)]


def test_patches_of_many_colours_come_back(spark):
    from frameloom.functions.tokenizers import PatchTokenizer

    kind = PatchTokenizer(4, 4, 8, 14)  # tokens beyond 2 ** 53
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 14, 32).tolist(),) for _ in range(20)] + [([13] * 32,)]
    told = spark.createDataFrame(rows, "s array<long>").select("s", kind.decode(kind.encode(F.col("s"))).alias("back")).collect()
    assert all(list(r.s) == list(r.back) for r in told)


def test_rollouts(spark):
    from frameloom.errors import InvalidParams
    from frameloom.operators import stats

    frames = spark.createDataFrame([("t", 0, 0, i, i, [i], None) for i in range(12)], schema("int"))
    at = lambda df: sorted(r.pos for r in df.collect())
    assert at(stats.rollout(frames, 10, "final")) == [10] and at(stats.rollout(frames, 6, start=2, stride=3)) == [2, 5]
    with pytest.raises(InvalidParams):
        stats.rollout(frames, 1, "none")
