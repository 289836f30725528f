"""Seeds and the generator's random numbers, vectorised over samples with 64-bit unsigned NumPy arithmetic; seeds also as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: The finaliser's multipliers and the two stream increments.
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SHARD_STEP, SAMPLE_STEP = 0x9E3779B97F4A7C15, 0x517CC1B727220A95
#: Fixed value: what the generator starts from when its seed is 0.
ZERO_SEED = 0xDEADBEEFCAFEBABE


def _u64(x) -> np.ndarray:
    if isinstance(x, int):
        x %= 1 << 64
    return np.asarray(x).astype(np.uint64)


def mix(x) -> np.ndarray:
    """A 64-bit finaliser; 0 stays 0."""
    z = _u64(x)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def shard_seed(base, shard) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(_u64(base) ^ (_u64(shard) * np.uint64(SHARD_STEP)))


def sample_seed(seed, sample) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(_u64(seed) + _u64(sample) * np.uint64(SAMPLE_STEP))


class Draws:
    """Xorshift generators, one for each seed, that advance together."""

    def __init__(self, seeds):
        state = np.atleast_1d(_u64(seeds)).copy()
        state[state == 0] = np.uint64(ZERO_SEED)
        self.state, self.spare = state, None

    def u64(self) -> np.ndarray:
        s = self.state
        s = s ^ (s << np.uint64(13))
        s = s ^ (s >> np.uint64(7))
        self.state = s = s ^ (s << np.uint64(17))
        return s

    def f64(self) -> np.ndarray:
        return (self.u64() >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    def between(self, low: float, high: float) -> np.ndarray:
        return low + self.f64() * (high - low)

    def below(self, n: int) -> np.ndarray:
        return (self.u64() % np.uint64(n)).astype(np.int64)

    def coin(self) -> np.ndarray:
        return (self.u64() >> np.uint64(63)).astype(bool)

    def normal(self) -> np.ndarray:
        """Pairs of normal draws from two uniform ones; the second of a pair waits for the next call."""
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        before = self.state
        u = self.f64()
        while (low := u <= 1e-30).any():  # those seeds draw again, alone
            kept, self.state = self.state, np.where(low, self.state, before)
            again = self.f64()
            u, self.state = np.where(low, again, u), np.where(low, self.state, kept)
        v = self.f64()
        size, angle = np.sqrt(-2.0 * np.log(u)), 2.0 * np.pi * v
        self.spare = size * np.sin(angle)
        return size * np.cos(angle)


# ---- the same as columns: a bigint holds the 64 bits, and nothing overflows, since products are taken of parts of 32 and 16 bits ----
LOW, LOWER = (1 << 32) - 1, (1 << 16) - 1


def added(a: Column, b: Column) -> Column:
    """a + b modulo 2**64."""
    low = a.bitwiseAND(LOW) + b.bitwiseAND(LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(LOW))


def times(a: Column, factor: int) -> Column:
    """a * factor modulo 2**64."""
    part = [F.lit(factor >> 16 * i & LOWER).cast("bigint") for i in range(4)]
    low, high = a.bitwiseAND(LOW), F.shiftrightunsigned(a, 32)
    shifted = lambda y: F.shiftleft(y.bitwiseAND(LOWER), 16)
    below = low * part[0] + shifted(low * part[1])
    carried = F.shiftrightunsigned(below, 32) + F.shiftrightunsigned(low * part[1], 16)
    above = carried + low * part[2] + shifted(low * part[3]) + high * part[0] + shifted(high * part[1])
    return F.shiftleft(above, 32).bitwiseOR(below.bitwiseAND(LOW))


def _mixed(df: DataFrame, name: str, first: Column) -> DataFrame:
    """df with the finaliser of `first`, in projections one on another: each names the one before several times, and generated code
    computes it once."""
    turned = lambda bits: F.col(name).bitwiseXOR(F.shiftrightunsigned(name, bits))
    for step in (first, turned(30), times(F.col(name), MIX_A), turned(27), times(F.col(name), MIX_B), turned(31)):
        df = df.withColumn(name, step)
    return df


def with_shard_seed(df: DataFrame, name: str, base: Column, shard: Column) -> DataFrame:
    """df with shard_seed of whole numbers as a bigint; null where one of them is null."""
    return _mixed(df, name, base.cast("bigint").bitwiseXOR(times(shard.cast("bigint"), SHARD_STEP)))


def with_sample_seed(df: DataFrame, name: str, seed: Column, sample: Column) -> DataFrame:
    """df with sample_seed of whole numbers as a bigint; null where one of them is null."""
    return _mixed(df, name, added(seed.cast("bigint"), times(sample.cast("bigint"), SAMPLE_STEP)))


def hex16(c: Column) -> Column:
    """A seed as sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
