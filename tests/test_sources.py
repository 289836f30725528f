import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.errors import DuplicateName, InvalidParams, UnknownName
from frameloom.functions import automata as A
from frameloom.functions.seeds import Draws, sample_seed, shard_seed
from frameloom.sources import rules
from frameloom.sources.generate import generate, register_sources
from frameloom.sources.kernels import GENERATORS, grid_kernel, sample_frames, shifted, step_rule
from frameloom.sources.readers import brackets, champernowne

NAMES = ["ca", "ca2d", "ca3d", "nca2d", "lorenz", "logistic", "nbody", "lsystem", "vm", "boolean_network", "ifs", "formal_grammar"]
SMALL = {"width": 9, "rows": 4, "cols": 4, "depth": 3, "rules": {"F": "FF"}, "productions": {"S": ["aSb", "SS", ""]}}


def test_seeds():
    assert [int(shard_seed(*a)) for a in ((0, 0), (42, 0), (42, 1), (12345, 0))] == [0, 0xA759EA27D4727622, 0xBDD732262FEB6E95, 0xF36CF1164265DD51]
    assert [int(sample_seed(shard_seed(42, 0), i)) for i in range(3)] == [0x97EA87F7E45C00A5, 0x55A757126819031C, 0x111A61155F454633]
    draws = Draws([42])
    assert [int(draws.u64()[0]) for _ in range(3)] == [0xA95514AAA, 0xA00AAAFDF80202BF, 0x8B13399CD1D1497A]
    assert float(Draws([42]).f64()[0]) == 2.4641099161115676e-09
    bits = [bin(int(shard_seed(1, i)) ^ int(shard_seed(1, i + 1))).count("1") for i in range(100)]
    assert min(bits) >= 10


@pytest.mark.parametrize(("rule", "edge", "rows"), [
    (30, "periodic", "00111111 11100000 10010001"), (30, "fixed", "00111111 01100000 11010000"), (30, "reflective", "00111111 01100000 11010000"),
    (90, "periodic", "00101101 11001100 11111111"), (90, "fixed", "00101101 01001100 10111110"), (90, "reflective", "00101101 01001101 10111101"),
    (110, "periodic", "00110110 01111110 11000010"), (184, "periodic", "00001001 10000100 01000010"), (184, "fixed", "00001001 00000100 00000010"), (184, "reflective", "00001001 00000101 00000011"),
])
def test_elementary_vectors(spark, rule, edge, rows):
    table = np.array([rule >> i & 1 for i in range(8)], bool)
    grid, got = np.array([[c == "1" for c in "00010010"]]), []
    for _ in range(3):
        left, right = (shifted(grid, (s,), edge).astype(int) for s in (-1, 1))
        grid = table[4 * left + 2 * grid + right]
        got.append("".join("01"[int(v)] for v in grid[0]))
    assert got == rows.split()
    start = F.array(*[F.lit(int(c)).cast("bigint") for c in "00010010"])
    told = spark.range(1).select(A.history(start, lambda s: A.elementary_step(s, rule, 8, edge), 3)).first()[0]
    assert ["".join(map(str, s)) for s in told[1:]] == rows.split()


def test_blinker_and_isotropic_life():
    config = {"boundary": "fixed"}
    grid = np.zeros((1, 5, 5), np.uint8)
    grid[0, 2, 1:4] = 1
    _, life = step_rule(config, rules.MOORE, rules.CROSS)
    assert (life(grid)[0].T == grid[0]).all()
    _, same = step_rule({"rule_type": "hensel", "hensel_notation": "B3/S23"}, rules.MOORE, rules.CROSS)
    _, wrapped = step_rule({}, rules.MOORE, rules.CROSS)
    random = np.random.default_rng(0).integers(0, 2, (3, 9, 7)).astype(np.uint8)
    assert (same(random) == wrapped(random)).all()


def test_orbits_and_notation():
    counts = [sum(n == k for n, _ in rules.orbits()) for k in range(9)]
    assert counts == [1, 2, 6, 10, 13, 10, 6, 2, 1] and sum(map(len, rules.orbits().values())) == 256
    assert rules.isotropic_table("B/S").sum() == 0 and rules.isotropic_table("B012345678/S").sum() == 256
    assert rules.table_of_hex("8" + "0" * 127).nonzero()[0].tolist() == [0]
    for bad in ("B3S23", "B9/S", "B3z/S", "3/23"):
        with pytest.raises(InvalidParams):
            rules.isotropic_table(bad)


@pytest.mark.parametrize("name", NAMES)
def test_same_seed_same_frames(spark, name):
    kernel = GENERATORS.get(name)(SMALL)
    first = list(sample_frames(kernel, 7, 4))
    assert first == list(sample_frames(kernel, 7, 4))
    if name not in ("lsystem",):
        assert any(list(sample_frames(kernel, s, 4)) != first for s in (8, 9, 10))
    table = generate(spark, name, SMALL, count=7, seq_length=4, seed=3, shard_size=3)
    other = generate(spark, name, SMALL, count=7, seq_length=4, seed=3, shard_size=3, partitions=1)
    rows = lambda df: sorted((r.shard_id, r.sample_id, r.step_index, list(r.state)) for r in df.collect())
    assert rows(table) == rows(other)
    seed = int(sample_seed(shard_seed(3, 1), 2))
    assert [s for shard, i, _, s in rows(table) if (shard, i) == (1, 2)] == list(map(list, sample_frames(kernel, seed, 4)))


@pytest.mark.parametrize("preset", sorted(rules.PRESETS[2]))
def test_presets(preset):
    frames = list(sample_frames(GENERATORS.get("ca2d")({"preset": preset, "rows": 8, "cols": 8}), 5, 3))
    assert [len(f) for f in frames] == [64] * 3


def test_logistic_and_rewriting():
    got = [f[0] for f in sample_frames(GENERATORS.get("logistic")({"x0": 0.2}), 0, 5)]
    assert got == pytest.approx([0.2, 0.6240000000000001, 0.9150335999999998, 0.30321373239705673, 0.8239731430433209])
    assert [len(f) for f in sample_frames(GENERATORS.get("lsystem")({"rules": {"F": "FF"}, "iterations": 3}), 0, 0)] == [1, 2, 4, 8]
    assert len(list(sample_frames(GENERATORS.get("lsystem")({"rules": {"F": "FF"}, "iterations": 9, "max_string_length": 5}), 0, 0))) == 3


def test_wrong_parameters(spark):
    for name, config in (("ca", {"rule": 256}), ("ca", {"width": 0}), ("ca2d", {"rule_type": "none"}), ("ca2d", {"preset": "xrule"}), ("ca2d", {"rule_type": "totalistic", "table": [0]}), ("lorenz", {"dt": 0}), ("logistic", {"r": 5}), ("ca", {"boundary": "open"}), ("ca2d", {"rule_type": "wireworld"})):
        with pytest.raises(InvalidParams):
            GENERATORS.get(name)(config)
    with pytest.raises(UnknownName):
        GENERATORS.get("nothing")
    with pytest.raises(DuplicateName):
        GENERATORS.register("ca", None)
    with pytest.raises(InvalidParams):
        generate(spark, "ca", seq_length=0)
    assert grid_kernel({"init_mode": "single_center"}, (3, 3), rules.MOORE, rules.CROSS).kind == "int"


def test_data_source(spark):
    register_sources(spark)
    read = spark.read.format("frameloom").options(generator="ca", config='{"width": 8}', count="5", shard_size="2", seq_length="3", seed="9").load()
    made = generate(spark, "ca", {"width": 8}, count=5, seq_length=3, seed=9, shard_size=2)
    key = ["shard_id", "sample_id", "step_index", "state"]
    assert sorted(map(str, read.select(key).collect())) == sorted(map(str, made.select(key).collect()))


def test_failing_shard_is_a_row(spark, monkeypatch):
    from frameloom.sources import generate as module

    whole = module.shard_batches

    def breaks(task, generator, config, steps, seed, shard, samples):
        if shard == 1:
            raise RuntimeError("out of luck")
        return whole(task, generator, config, steps, seed, shard, samples)

    monkeypatch.setattr(module, "shard_batches", breaks)
    out = generate(spark, "ca", {"width": 4}, count=6, seq_length=2, shard_size=2, isolate=True)
    assert [(r.shard_id, r.error) for r in out.where("error is not null").distinct().collect()] == [(1, "RuntimeError: out of luck")] * 1
    assert sorted({r.shard_id for r in out.where("error is null").collect()}) == [0, 2]


def test_synthetic_languages(spark):
    from frameloom.functions import frames as X

    for shuffled in (False, True):
        out = brackets(spark, 20, 3, 12, 5, shuffled)
        check = X.shuffle_dyck_valid if shuffled else X.dyck_valid
        assert out.where(check(F.col("state"), 3) & (F.size("state") == 12)).count() == 20
    assert [list(r.state) for r in champernowne(spark, 2, 9, 2).orderBy("sample_id").collect()] == [[9, 1, 0], [1, 0, 1, 1]]


def test_tiled_start_shares_its_chances():
    from frameloom.sources.kernels import GENERATORS

    seeds = np.arange(1, 60, dtype=np.uint64)
    first = {m: next(GENERATORS.get("nca2d")({"rows": 10, "cols": 10, "n_groups": 2, "d_state": 5, "init_mode": m}).run(seeds)) for m in ("cells", "tiled")}
    top = lambda cells: np.array([[np.bincount(row[g::2], minlength=5).max() for g in (0, 1)] for row in cells])
    assert top(first["tiled"]).mean() > top(first["cells"]).mean() + 10  # one colour leads in each group


def test_seeds_as_columns_are_those_of_numpy(spark):
    from frameloom.functions.seeds import with_sample_seed, with_shard_seed

    edges = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, 2**32 - 1, 2**31, 42]
    drawn = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 60)]
    rows = [(a, b) for a in edges for b in edges] + list(zip(drawn, reversed(drawn), strict=True)) + [(None, 1), (1, None)]
    made = with_shard_seed(spark.createDataFrame(rows, "a long, b long"), "shard", F.col("a"), F.col("b"))
    out = with_sample_seed(made, "sample", F.col("a"), F.col("b")).collect()
    for r in out:
        if r.a is None or r.b is None:
            assert r.shard is None and r.sample is None
            continue
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (r.shard % (1 << 64), r.sample % (1 << 64)) == (int(shard_seed(a, b)), int(sample_seed(a, b)))
