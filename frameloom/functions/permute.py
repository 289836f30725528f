"""A keyed permutation of the numbers 0 .. n-1 as a column: what draws without replacement without a table of what was drawn.

Numbers are laid out on a rectangle of a x b places with a * b >= n, and each round moves one coordinate by a keyed hash of the
other (a Feistel network over two moduli), so every key gives a permutation of the rectangle. A number that lands at n or beyond
is moved again until it lands below: that walks along its own cycle, so what remains is a permutation of 0 .. n-1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from frameloom.functions.frames import let

ROUNDS = 6
#: Moves after a first one at most. Fewer than a places lie beyond n, so a walk needs no more for n up to WALK**2; beyond, a walk
#: this long has a chance below WALK**-WALK, and is an error rather than a wrong number.
WALK = 32


def sides(n: Column) -> tuple[Column, Column]:
    """The rectangle for n numbers: a is the square root, rounded up, and b what covers n."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1))
    return a, F.greatest(F.ceil(n.cast("double") / a).cast("bigint"), F.lit(1))


def keyed(key: Column, round_: int, value: Column, below: Column) -> Column:
    """A number below `below`, from the first 60 bits of a digest that SQL engines agree on."""
    digest = F.md5(F.concat_ws(":", key, F.lit(str(round_)), value.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % below


def moved(x: Column, a: Column, b: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where the permutation of the rectangle takes x."""
    place = F.struct((x % a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))

    def turn(p: Column, i: int) -> Column:
        l, r = p["l"], p["r"]  # noqa: E741
        if i % 2 == 0:
            l = (l + keyed(key, i, r, a)) % a  # noqa: E741
        else:
            r = (r + keyed(key, i, l, b)) % b
        return F.struct(l.alias("l"), r.alias("r"))

    def all_turns(p: Column, i: int) -> Column:
        return p["l"] + a * p["r"] if i == rounds else let(turn(p, i), lambda q: all_turns(q, i + 1))

    return let(place, lambda p: all_turns(p, 0))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where the key's permutation of 0 .. n-1 takes x; null unless 0 <= x < n."""
    a, b = sides(n)
    again = lambda at, _: F.when(at < n, at).otherwise(moved(at, a, b, key, rounds))
    first = moved(x, a, b, key, rounds)
    landed = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, again)
    sure = let(landed, lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("a walk of the permutation was too long")).cast("bigint")))
    return F.when((x >= 0) & (x < n), sure)
