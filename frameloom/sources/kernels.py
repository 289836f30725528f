"""Generators: from seeds to frames, vectorised over the samples of a batch.

A uniform kernel keeps one array with a row for each sample and yields it step after step. Kernels whose frames differ in
number or width from sample to sample yield a list of frames for each seed. The same seed gives the same frames whatever the
batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np

from frameloom.errors import GeneratorNotFound, InvalidParams
from frameloom.functions.seeds import Draws
from frameloom.registry import Registry
from frameloom.sources import rules


@dataclass(frozen=True)
class Kernel:
    """kind is the cell type. run(seeds) yields, step by step, an array (samples, cells); ragged(seed) yields one sample's frames."""

    kind: str
    run: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None
    ragged: Callable[[int], Iterator[list]] | None = None
    endless: bool = True


GENERATORS: Registry[Callable[[dict], Kernel]] = Registry("generator", GeneratorNotFound)


def option(config: dict, name: str, default, kind=None, check: Callable = lambda x: True):
    value = config.get(name, default)
    try:
        value = kind(value) if kind and value is not None else value
    except (TypeError, ValueError) as e:
        raise InvalidParams(f"{name}: {value!r} is not of the right type") from e
    if not check(value):
        raise InvalidParams(f"{name}: {value!r} is out of range")
    return value


def positive(x) -> bool:
    return x is not None and x > 0


BOUNDARIES = ("periodic", "fixed", "reflective")


def shifted(grid: np.ndarray, offsets: tuple[int, ...], boundary: str) -> np.ndarray:
    """grid (samples, axes...) where each cell holds its neighbour at the offsets; beyond the edge: wrapped, 0 or the edge itself."""
    out = grid
    for axis, by in enumerate(offsets, start=1):
        if by == 0:
            continue
        n = grid.shape[axis]
        at = np.arange(n) + by
        inside = (at >= 0) & (at < n)
        out = np.take(out, at % n if boundary == "periodic" else np.clip(at, 0, n - 1), axis=axis)
        if boundary == "fixed" and not inside.all():
            mask = [np.newaxis] * out.ndim
            mask[axis] = slice(None)
            out = np.where(inside[tuple(mask)], out, np.zeros((), out.dtype))
    return out


def boundary_of(config: dict) -> str:
    return option(config, "boundary", "periodic", str, lambda b: b in BOUNDARIES)


@GENERATORS.named("ca", "cellular_automaton")
def elementary(config: dict) -> Kernel:
    """A row of cells; bit 4 * left + 2 * self + right of the rule's number is the next state."""
    config = rules.with_preset(config, 1)
    rule, width = option(config, "rule", 30, int, lambda r: 0 <= r < 256), option(config, "width", 128, int, positive)
    boundary, table = boundary_of(config), np.array([rule >> i & 1 for i in range(8)], bool)

    def run(seeds):
        draws = Draws(seeds)
        grid = np.stack([draws.coin() for _ in range(width)], axis=1)
        while True:
            yield grid
            left, right = (shifted(grid, (s,), boundary).astype(np.uint8) for s in (-1, 1))
            grid = table[4 * left + 2 * grid.astype(np.uint8) + right]

    return Kernel("bool", run)


def step_rule(config: dict, moore: list, cross: list) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """The number of states and the step function of a grid's rule family."""
    boundary = boundary_of(config)
    hood = option(config, "neighborhood", "moore", lambda s: str(s).lower().replace("_", "").replace("-", ""), lambda s: s in ("moore", "vonneumann"))
    offsets = moore if hood == "moore" else cross
    family = option(config, "rule_type", "lifelike", lambda s: str(s).lower())
    states = option(config, "d_state", 2, int, lambda d: 2 <= d <= 255)
    around = lambda g: (shifted(g, o, boundary) for o in offsets)
    total = lambda g: sum(n.astype(np.int32) for n in around(g))
    alive = lambda g: sum((n > 0).astype(np.int32) for n in around(g))
    three = len(moore[0]) == 3
    if family == "lifelike":
        if states != 2:
            raise InvalidParams("life-like rules have two states")
        luts = []
        for name, default in (("birth", [5, 6, 7] if three else [3]), ("survival", [5, 6] if three else [2, 3])):
            lut = np.zeros(len(moore) + 1, np.uint8)
            for n in option(config, name, default, list):
                if not 0 <= n <= len(moore):
                    raise InvalidParams(f"{name}: {n} neighbours are too many")
                lut[n] = 1
            luts.append(lut)
        return 2, lambda g: np.where(g > 0, luts[1][alive(g)], luts[0][alive(g)])
    if family == "totalistic":
        table = np.array(option(config, "totalistic_table", config.get("table"), lambda t: list(t)), np.int64)
        most = len(offsets) * (states - 1)
        if len(table) <= most:
            raise InvalidParams(f"a totalistic table needs {most + 1} entries")
        table = np.where((table >= 0) & (table < states), table, 0).astype(np.uint8)
        return states, lambda g: table[total(g)]
    if family == "cyclic":
        states = option(config, "n_states", 14, int, lambda n: 2 <= n <= 255)
        least = option(config, "threshold", 1, int, lambda t: t >= 1)

        def cycle(g):
            after = ((g.astype(np.int32) + 1) % states).astype(np.uint8)
            return np.where(sum((n == after).astype(np.int32) for n in around(g)) >= least, after, g)

        return states, cycle
    if family == "fredkin" and three:
        if states != 2:
            raise InvalidParams("this rule has two states")
        return 2, lambda g: (total(g) % 2).astype(np.uint8)
    if family == "wireworld" and not three:
        if states != 4:
            raise InvalidParams("this rule has four states")

        def wire(g):
            heads = sum((n == 1).astype(np.int32) for n in around(g))
            return np.select([g == 1, g == 2, g == 3], [2, 3, np.where((heads == 1) | (heads == 2), 1, 3)], 0).astype(np.uint8)

        return 4, wire
    if family in ("hensel", "lookuptable") and not three:
        if states != 2 or hood != "moore":
            raise InvalidParams("look-up tables are for two states and eight neighbours")
        if family == "hensel":
            table = rules.isotropic_table(option(config, "hensel_notation", None, str, bool))
        elif config.get("lookup_table_hex") is not None:
            table = rules.table_of_hex(config["lookup_table_hex"])
        elif config.get("lookup_table_array") is not None:
            table = rules.table_of_items(list(config["lookup_table_array"]))
        else:
            raise InvalidParams("a look-up table is wanted, in hexadecimal or as an array")

        def look(g):
            bits = sum((n > 0).astype(np.int32) << i for i, n in enumerate(around(g)))
            return table[(g > 0).astype(np.int32) * 256 + bits].astype(np.uint8)

        return 2, look
    raise InvalidParams(f"no rule type {family!r} here")


def grid_kernel(config: dict, shape: tuple[int, ...], moore: list, cross: list) -> Kernel:
    states, step = step_rule(config, moore, cross)
    init = option(config, "init_mode", "random", lambda s: str(s).lower().replace("_", ""), lambda s: s in ("random", "singlecenter"))
    cells = int(np.prod(shape))

    def run(seeds):
        draws = Draws(seeds)
        grid = np.zeros((len(draws.state), cells), np.uint8)
        if init == "random":
            for i in range(cells):
                grid[:, i] = draws.below(states)
        else:
            grid[:, np.ravel_multi_index([n // 2 for n in shape], shape)] = 1
        grid = grid.reshape(-1, *shape)
        while True:
            yield grid.reshape(len(grid), -1).astype(np.int64)
            grid = step(grid).astype(np.uint8)

    return Kernel("int", run)


@GENERATORS.named("ca2d", "cellular_automaton_2d")
def flat(config: dict) -> Kernel:
    config = rules.with_preset(config, 2)
    return grid_kernel(config, tuple(option(config, n, 64, int, positive) for n in ("rows", "cols")), rules.MOORE, rules.CROSS)


@GENERATORS.named("ca3d", "cellular_automaton_3d")
def solid(config: dict) -> Kernel:
    config = rules.with_preset(config, 3)
    return grid_kernel(config, tuple(option(config, n, 16, int, positive) for n in ("depth", "rows", "cols")), rules.MOORE3, rules.CROSS3)


def pick(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first place at which the cumulated softmax exceeds u, the last one if none does."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    cumulated = np.cumsum(e / e.sum(axis=-1, keepdims=True), axis=-1)
    over = u[..., None] < cumulated
    return np.where(over.any(axis=-1), over.argmax(axis=-1), logits.shape[-1] - 1)


@GENERATORS.named("nca2d", "neural_cellular_automaton_2d")
def neural(config: dict) -> Kernel:
    """Each seed has its own random network: 3 x 3 and two 1 x 1 convolutions over one-hot cells, with wrapped edges.

    Each cell of the first frame is drawn by logits of its own or, with init_mode `tiled`, by those that its group has for all cells.
    """
    states, groups = option(config, "d_state", 10, int, lambda d: 2 <= d <= 255), option(config, "n_groups", 1, int, positive)
    rows, cols = (option(config, n, 12, int, positive) for n in ("rows", "cols"))
    bias, heat = option(config, "identity_bias", 0.0, float), option(config, "temperature", 0.0, float, lambda t: t >= 0)
    hidden, features = option(config, "hidden_dim", 16, int, positive), option(config, "conv_features", 4, int, positive)
    channels = states * groups
    tiled = option(config, "init_mode", "cells", str, lambda m: m in ("cells", "tiled")) == "tiled"

    def run(seeds):
        draws = Draws(seeds)
        n = len(draws.state)
        layer = lambda *shape, fan: np.stack([draws.normal() for _ in range(int(np.prod(shape)))], axis=1).reshape(n, *shape) / np.sqrt(fan)
        first = layer(3, 3, channels, features, fan=9 * channels)
        second, third = layer(features, hidden, fan=features), layer(hidden, channels, fan=hidden)
        cells = np.empty((n, rows * cols * groups), np.int64)
        for i in range(cells.shape[1]):
            if not tiled or i < groups:
                logits = np.stack([draws.normal() for _ in range(states)], axis=1)
                shared = [logits] if i == 0 or not tiled else [*shared, logits]
            cells[:, i] = pick(shared[i % groups] if tiled and i >= groups else logits, draws.f64())
        while True:
            yield cells.copy()
            hot = (cells.reshape(n, rows, cols, groups, 1) == np.arange(states)).astype(np.float64)
            grid = hot.reshape(n, rows, cols, channels)
            near = np.zeros((n, rows, cols, features))
            for i in range(3):
                for j in range(3):
                    near += np.einsum("nrch,nhk->nrck", np.roll(grid, (1 - i, 1 - j), (1, 2)), first[:, i, j])
            logits = np.einsum("nrch,nhk->nrck", np.maximum(np.einsum("nrch,nhk->nrck", near, second), 0), third)
            logits = logits.reshape(n, rows * cols * groups, states) + bias * hot.reshape(n, -1, states)
            if heat == 0:
                cells = logits.argmax(axis=-1)
            else:
                u = np.stack([draws.f64() for _ in range(logits.shape[1])], axis=1)
                cells = pick(logits / heat, u)

    return Kernel("int", run)


def finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def runge_kutta(f: Callable, y: np.ndarray, dt: float) -> np.ndarray:
    a = f(y)
    b = f(y + dt / 2 * a)
    c = f(y + dt / 2 * b)
    d = f(y + dt * c)
    return y + dt / 6 * (a + 2 * b + 2 * c + d)


@GENERATORS.named("lorenz", "lorenz_system")
def lorenz(config: dict) -> Kernel:
    sigma, rho, beta = option(config, "sigma", 10.0, float), option(config, "rho", 28.0, float), option(config, "beta", 8.0 / 3.0, float)
    dt = option(config, "dt", 0.01, float, positive)
    slope = lambda y: np.stack([sigma * (y[:, 1] - y[:, 0]), y[:, 0] * (rho - y[:, 2]) - y[:, 1], y[:, 0] * y[:, 1] - beta * y[:, 2]], axis=1)

    def run(seeds):
        draws = Draws(seeds)
        y = np.stack([draws.between(-15.0, 15.0) for _ in range(3)], axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            while True:
                yield finite(y)
                y = runge_kutta(slope, y, dt)

    return Kernel("float", run)


@GENERATORS.named("logistic", "logistic_map")
def logistic(config: dict) -> Kernel:
    """A sample ends after the frame from which x leaves 0..1."""
    r = option(config, "r", 3.9, float, lambda v: 0 <= v <= 4)
    x0 = option(config, "x0", None, float, lambda v: v is None or 0 <= v <= 1)

    def ragged(seed):
        x = x0 if x0 is not None else float(Draws([seed]).between(0.01, 0.99)[0])
        while 0.0 <= x <= 1.0:
            yield [x]
            x = r * x * (1.0 - x)

    return Kernel("float", ragged=ragged)


@GENERATORS.named("nbody", "nbody_sim")
def gravity(config: dict) -> Kernel:
    bodies = option(config, "num_bodies", 5, int, positive)
    dt, soft = option(config, "dt", 0.01, float, positive), option(config, "softening", 0.1, float, lambda s: s >= 0)
    method = option(config, "integrator", "rk4", lambda s: str(s).lower(), lambda s: s in ("rk4", "euler"))

    def run(seeds):
        draws = Draws(seeds)
        drawn = np.stack([draws.between(*b) for _ in range(bodies) for b in ((-10.0, 10.0), (-10.0, 10.0), (-1.0, 1.0), (-1.0, 1.0), (0.5, 2.0))], axis=1).reshape(-1, bodies, 5)
        y, mass = drawn[:, :, :4].copy(), drawn[:, :, 4]

        def pull(at):
            apart = at[:, None, :, :] - at[:, :, None, :]
            square = (apart**2).sum(axis=-1) + soft * soft
            with np.errstate(divide="ignore"):
                force = mass[:, None, :] / (square * np.sqrt(square))
            force[:, np.arange(bodies), np.arange(bodies)] = 0
            return (force[..., None] * apart).sum(axis=2)

        slope = lambda s: np.concatenate([s[:, :, 2:], pull(s[:, :, :2])], axis=2)
        while True:
            yield finite(y.reshape(len(y), -1))
            if method == "rk4":
                y = runge_kutta(slope, y, dt)
            else:  # velocities first, places with the new ones
                v = y[:, :, 2:] + dt * pull(y[:, :, :2])
                y = np.concatenate([y[:, :, :2] + dt * v, v], axis=2)

    return Kernel("float", run)


@GENERATORS.named("lsystem")
def rewriting(config: dict) -> Kernel:
    """All symbols are replaced at once; a string longer in bytes than the cap is not emitted and ends the sample."""
    axiom, table = option(config, "axiom", "F", str, bool), {str(k): str(v) for k, v in option(config, "rules", {}, dict).items()}
    rounds, most = option(config, "iterations", 5, int, lambda i: i >= 0), option(config, "max_string_length", 1_000_000, int, positive)

    def ragged(seed):
        text = axiom
        for i in range(rounds + 1):
            yield [ord(c) for c in text]
            if i < rounds:
                text = "".join(table.get(c, c) for c in text)
                if len(text.encode()) > most:
                    return

    return Kernel("int", ragged=ragged, endless=False)


def _draws(seed: int) -> Callable[[], int]:
    draws = Draws([seed])
    return lambda: int(draws.u64()[0])


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


#: Instructions by number.
INSTRUCTIONS = ("push", "pop", "add", "sub", "mul", "div", "dup", "swap", "jmp", "jz", "halt")


@GENERATORS.named("vm", "algorithm_vm")
def machine(config: dict) -> Kernel:
    """A random stack program; frames hold the counter and the top of the stack before each instruction."""
    size, most = option(config, "program_size", 32, int, positive), option(config, "max_steps", 1000, int, positive)

    def ragged(seed):
        draw = _draws(seed)
        program = []
        for _ in range(size - 1):
            name = INSTRUCTIONS[draw() % 11]
            value = 0
            if name == "push":
                signed = _wrapped(draw())
                value = abs(signed) % 100 * (1 if signed >= 0 else -1)
            elif name in ("jmp", "jz"):
                value = draw() % size
            program.append((name, value))
        program.append(("halt", 0))
        stack: list[int] = []
        at = 0
        for _ in range(most):
            yield [at, stack[-1] if stack else 0]
            if at >= len(program):
                return
            name, value = program[at]
            two = len(stack) >= 2
            at += 1
            if name == "halt":
                return
            if name == "push":
                stack.append(value)
            elif name == "pop" and stack:
                stack.pop()
            elif name in ("add", "sub", "mul") and two:
                b, a = stack.pop(), stack.pop()
                stack.append(_wrapped(a + b if name == "add" else a - b if name == "sub" else a * b))
            elif name == "div" and two and stack[-1]:
                b, a = stack.pop(), stack.pop()
                stack.append(_wrapped(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)))
            elif name == "dup" and stack:
                stack.append(stack[-1])
            elif name == "swap" and two:
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif name == "jmp" or name == "jz" and (stack.pop() if stack else 0) == 0:
                at = value

    return Kernel("int", ragged=ragged)


@GENERATORS.named("boolean_network")
def network(config: dict) -> Kernel:
    """Every node has a random truth table over three random nodes; all change at once."""
    nodes = option(config, "num_nodes", 32, int, positive)

    def run(seeds):
        draws = Draws(seeds)
        tables = np.stack([draws.coin() for _ in range(8 * nodes)], axis=1).reshape(-1, nodes, 8)
        parents = np.stack([draws.below(nodes) for _ in range(3 * nodes)], axis=1).reshape(-1, nodes, 3)
        state = np.stack([draws.coin() for _ in range(nodes)], axis=1)
        sample = np.arange(len(state))
        while True:
            yield state
            a, b, c = (state[sample[:, None], parents[:, :, i]].astype(np.int64) for i in range(3))
            state = np.take_along_axis(tables, (4 * a + 2 * b + c)[:, :, None], axis=2)[:, :, 0]

    return Kernel("bool", run)


@GENERATORS.named("ifs")
def chaos_game(config: dict) -> Kernel:
    """Random affine maps, drawn anew at each step by their chances; the first whose cumulated chance reaches the draw."""
    maps = option(config, "num_transforms", 4, int, positive)

    def run(seeds):
        draws = Draws(seeds)
        bounds = ((0.1, 1.0), *[(-1.0, 1.0)] * 4, *[(-0.5, 0.5)] * 2)
        drawn = np.stack([draws.between(*b) for _ in range(maps) for b in bounds], axis=1).reshape(-1, maps, 7)
        total = np.zeros(len(drawn))
        for i in range(maps):
            total = total + drawn[:, i, 0]
        cumulated = np.cumsum(drawn[:, :, 0] / total[:, None], axis=1)
        sample = np.arange(len(drawn))
        x, y = np.zeros(len(drawn)), np.zeros(len(drawn))
        with np.errstate(over="ignore", invalid="ignore"):
            while True:
                yield np.stack([finite(x), finite(y)], axis=1)
                reached = draws.f64()[:, None] <= cumulated
                _, a, b, c, d, e, f = drawn[sample, np.where(reached.any(axis=1), reached.argmax(axis=1), maps - 1)].T
                x, y = a * x + b * y + e, c * x + d * y + f

    return Kernel("float", run)


@GENERATORS.named("formal_grammar")
def grammar(config: dict) -> Kernel:
    """The leftmost capital that has productions is replaced by a random one, until none is left or the limit is reached."""
    table = {str(k): [str(v) for v in vs] for k, vs in option(config, "productions", {}, dict).items()}
    start, most = option(config, "start_symbol", "S", str, lambda s: len(s) == 1), option(config, "max_derivations", 100, int, lambda m: m >= 0)

    def ragged(seed):
        draw, text = _draws(seed), start
        for done in count():
            yield [ord(c) for c in text]
            at = next((i for i, c in enumerate(text) if "A" <= c <= "Z" and table.get(c)), None)
            if at is not None and done < most:
                choices = table[text[at]]
                text = text[:at] + choices[draw() % len(choices)] + text[at + 1 :]

    return Kernel("int", ragged=ragged)


def sample_frames(kernel: Kernel, seed: int, steps: int) -> Iterator[list]:
    """One sample's frames; steps 0 means as many as there are."""
    if kernel.ragged:
        source = kernel.ragged(seed)
    else:
        source = (grid[0].tolist() for grid in kernel.run(np.array([seed], np.uint64)))
    return islice(source, steps) if steps else source
