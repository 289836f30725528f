"""Steps of cellular automata, rewriting systems and maps as expressions over arrays: no Python in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _at(i: Column, n: int, boundary: str) -> Column:
    """An index that wraps, sticks to the edge, or is null beyond it."""
    if boundary == "periodic":
        return F.pmod(i, F.lit(n))
    if boundary == "reflective":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    return F.when((i >= 0) & (i < n), i)


def elementary_step(state: Column, rule: int, width: int, boundary: str = "periodic") -> Column:
    """Cells 0 and 1; bit 4 * left + 2 * self + right of the rule."""
    cell = lambda i: F.coalesce(F.get(state, _at(i, width, boundary)), F.lit(0)).cast("int")
    table = F.array(*[F.lit(rule >> i & 1).cast("bigint") for i in range(8)])
    return F.transform(state, lambda v, i: F.get(table, 4 * cell(i - 1) + 2 * v.cast("int") + cell(i + 1)))


def around(state: Column, i: Column, shape: tuple[int, ...], offsets: list[tuple[int, ...]], boundary: str = "periodic") -> list[Column]:
    """The neighbours of cell i of a flat grid, 0 beyond a fixed edge."""
    out = []
    for offset in offsets:
        index, size = F.lit(0), 1
        for n, by in zip(reversed(shape), reversed(offset), strict=True):
            index = index + _at(F.floor(i / size).cast("int") % n + by, n, boundary) * size
            size *= n
        out.append(F.coalesce(F.get(state, index.cast("int")), F.lit(0)).cast("bigint"))
    return out


def grid_step(state: Column, shape: tuple[int, ...], offsets: list[tuple[int, ...]], rule: Callable[[Column, list[Column]], Column], boundary: str = "periodic") -> Column:
    """rule(cell, neighbours) for every cell of a flat grid."""
    return F.transform(state, lambda v, i: rule(v, around(state, i, shape, offsets, boundary)).cast("bigint"))


def _sum(xs: list[Column]) -> Column:
    return sum(xs[1:], xs[0])


def lifelike(birth: list[int], survival: list[int]) -> Callable[[Column, list[Column]], Column]:
    alive = lambda xs: _sum([(x > 0).cast("int") for x in xs])
    return lambda v, xs: F.when(v > 0, alive(xs).isin(survival or [-1])).otherwise(alive(xs).isin(birth or [-1]))


def totalistic(table: list[int]) -> Callable[[Column, list[Column]], Column]:
    return lambda v, xs: F.coalesce(F.get(F.array(*[F.lit(t) for t in table]), _sum(xs).cast("int")), F.lit(0))


def cyclic(states: int, least: int) -> Callable[[Column, list[Column]], Column]:
    return lambda v, xs: F.when(_sum([(x == (v + 1) % states).cast("int") for x in xs]) >= least, (v + 1) % states).otherwise(v)


def wireworld() -> Callable[[Column, list[Column]], Column]:
    heads = lambda xs: _sum([(x == 1).cast("int") for x in xs])
    return lambda v, xs: F.when(v == 1, 2).when(v == 2, 3).when((v == 3) & heads(xs).isin(1, 2), 1).when(v == 3, 3).otherwise(0)


def fredkin() -> Callable[[Column, list[Column]], Column]:
    return lambda v, xs: _sum(xs) % 2


def history(start: Column, step: Callable[[Column], Column], steps: int) -> Column:
    """[start, step(start), ...] with `steps` more states, by one fold over the array."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(start), lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))


def rewrite(text: Column, rules: dict[str, str]) -> Column:
    """Every character by its replacement at once."""
    if not rules:
        return text
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def logistic_step(x: Column, r: float) -> Column:
    return F.lit(r) * x * (1 - x)


def lorenz_step(state: Column, dt: float = 0.01, sigma: float = 10.0, rho: float = 28.0, beta: float = 8.0 / 3.0) -> Column:
    """One fourth-order step of (x, y, z)."""
    def slope(x, y, z):
        return sigma * (y - x), x * (rho - z) - y, x * y - beta * z

    s = tuple(F.element_at(state, i + 1) for i in range(3))
    moved = lambda k, h: tuple(a + h * b for a, b in zip(s, k, strict=True))
    a = slope(*s)
    b = slope(*moved(a, dt / 2))
    c = slope(*moved(b, dt / 2))
    d = slope(*moved(c, dt))
    return F.array(*[x + dt / 6 * (p + 2 * q + 2 * r + t) for x, p, q, r, t in zip(s, a, b, c, d, strict=True)])
