import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import queries
from frameloom.operators.pulls import pulls


def brute(rows):
    """By (system, body): the sum over rows of other bodies of the system, as SQL has it."""
    out = {}
    for s, i, x in rows:
        others = [y for t, j, y in rows if s is not None and i is not None and t == s and j is not None and j != i]
        if others:
            terms = out.setdefault((s, i), [])
            terms += [(y - x) / ((y - x) ** 2 + 1) ** 1.5 if math.isfinite(y - x) else math.nan for y in others if x is not None and y is not None]
    return {k: math.fsum(t) if t and not any(map(math.isnan, t)) else (math.nan if t else None) for k, t in out.items()}


def check(spark, rows):
    got = {(r.s, r.i): r.pull for r in pulls(spark.createDataFrame(rows, "s int, i long, x double"), ["s"], "i", "x").collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k] is None) if v is None else (math.isnan(got[k]) if math.isnan(v) else abs(got[k] - v) < 1e-11), (k, got[k], v)


@pytest.mark.parametrize("width", [0.2, 3.0, 50.0, 11_000.0, 1e9])
def test_pulls_are_sums_of_all_pairs(spark, width):
    x = np.random.default_rng(3).uniform(-width / 3, width, 300)
    check(spark, [(int(k % 2), k, float(v)) for k, v in enumerate(x)])


def test_pulls_of_odd_systems(spark):
    rows = [(0, 1, 0.5), (0, 2, 0.5), (0, 3, None), (0, 3, 2.0), (0, 3, -0.25), (0, None, 1.0), (None, 9, 1.0), (1, 1, 4.0), (1, 1, 5.0)]
    rows += [(2, 1, 1.0), (2, 2, None), (3, 1, None), (3, 2, None), (4, 1, math.nan), (4, 2, 1.0), (4, 3, 2.0), (5, 1, math.inf), (5, 2, 1.0)]
    rows += [(6, 1, 2.0**50), (6, 2, 2.0**50 + 1), (6, 3, 0.0), (7, 1, -3.0), (7, 2, -1.5), (8, 1, 1.0)]
    check(spark, rows)
    check(spark, rows[-1:])
    check(spark, [(3, 1, None), (3, 2, None)])


def test_a_large_system_is_no_table_of_pairs(spark, tmp_path):
    n = 200_000  # 4 * 10 ** 10 pairs
    x = ((F.col("id") * 7919) % 1_000_003 / 100.0 - 999).alias("s_acctbal")
    spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"), x).write.parquet(str(tmp_path / "supplier.parquet"))
    k = np.arange(n)
    at = (k * 7919) % 1_000_003 / 100.0 - 999
    for name, others in (("pairwise_one_system", lambda i: at), ("pairwise_theta_supplier", lambda i: at[k % 25 == i % 25])):
        got = queries.QUERIES[name](spark, str(tmp_path)).where(F.col("a") % 9973 == 5)
        rows = got.collect()
        assert len(rows) == len(range(5, n, 9973))
        for a, pull in rows:
            d = others(a) - at[a]
            assert abs(pull - float((d / (d * d + 1) ** 1.5).sum())) < 6e-7
