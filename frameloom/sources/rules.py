"""Rule tables of cellular automata: isotropic notation, look-up tables and presets."""

from __future__ import annotations

from functools import cache

import numpy as np

from frameloom.errors import InvalidParams

#: Letters of orbits in ascending order of their smallest pattern.
LETTERS = "cekainyqjrtwz"
#: The eight neighbours, row by row; neighbour i is bit i of a pattern.
MOORE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
MOORE3 = [(d, r, c) for d in (-1, 0, 1) for r in (-1, 0, 1) for c in (-1, 0, 1) if (d, r, c) != (0, 0, 0)]
CROSS3 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]

#: Presets by dimension.
PRESETS = {
    1: {f"{name}{n}": {"rule": n} for n in (30, 54, 90, 110, 184) for name in ("rule", "wolfram")},
    2: {
        "game_of_life": {"rule_type": "lifelike", "birth": [3], "survival": [2, 3], "d_state": 2},
        "conway": {"rule_type": "lifelike", "birth": [3], "survival": [2, 3], "d_state": 2},
        "highlife": {"rule_type": "lifelike", "birth": [3, 6], "survival": [2, 3], "d_state": 2},
        "day_night": {"rule_type": "lifelike", "birth": [3, 6, 7, 8], "survival": [3, 4, 6, 7, 8], "d_state": 2},
        "seeds": {"rule_type": "lifelike", "birth": [2], "survival": [], "d_state": 2},
        "diamoeba": {"rule_type": "lifelike", "birth": [3, 5, 6, 7, 8], "survival": [5, 6, 7, 8], "d_state": 2},
        "replicator_2d": {"rule_type": "lifelike", "birth": [1, 3, 5, 7], "survival": [1, 3, 5, 7], "d_state": 2},
        "maze": {"rule_type": "lifelike", "birth": [3], "survival": [1, 2, 3, 4, 5], "d_state": 2},
        "wireworld": {"rule_type": "wireworld", "d_state": 4},
        "cyclic": {"rule_type": "cyclic", "n_states": 14, "threshold": 1, "d_state": 14},
        "ameyalli": {"rule_type": "hensel", "hensel_notation": "B2ci3ar4krtz5cq6c7ce/S01e2ek3qj4kt5ceayq6cki7c8", "d_state": 2},
    },
    3: {
        "life_3d": {"rule_type": "lifelike", "birth": [5, 6, 7], "survival": [5, 6], "d_state": 2},
        "cyclic_3d": {"rule_type": "cyclic", "n_states": 14, "threshold": 1, "d_state": 14},
        "fredkin_3d": {"rule_type": "fredkin", "d_state": 2},
    },
}
#: Parameters that a preset replaces as a whole; others, such as those of the grid, stay.
RULE_KEYS = {"rule", "rule_type", "birth", "survival", "d_state", "n_states", "threshold", "hensel_notation", "lookup_table_hex", "lookup_table_array", "totalistic_table", "table"}


@cache
def orbits() -> dict[tuple[int, str], tuple[int, ...]]:
    """Patterns by (number of neighbours, letter): classes under the square's eight symmetries."""
    turns = [lambda r, c: (r, c), lambda r, c: (c, -r), lambda r, c: (-r, -c), lambda r, c: (-c, r)]
    moves = [[MOORE.index(turn(r, s * c)) for r, c in MOORE] for turn in turns for s in (1, -1)]
    found: dict[int, set[int]] = {}
    for pattern in range(256):
        images = {sum(1 << to for i, to in enumerate(move) if pattern >> i & 1) for move in moves}
        found.setdefault(min(images), images)
    out: dict[tuple[int, str], tuple[int, ...]] = {}
    for n in range(9):
        same = sorted(p for p in found if p.bit_count() == n)
        out |= {(n, LETTERS[i]): tuple(sorted(found[p])) for i, p in enumerate(same)}
    return out


def isotropic_table(notation: str) -> np.ndarray:
    """512 entries for 256 * centre + pattern, from B.../S... with digits and letters; a bare digit takes every orbit."""
    parts = notation.split("/")
    if len(parts) != 2 or not parts[0].startswith("B") or not parts[1].startswith("S"):
        raise InvalidParams(f"isotropic notation reads B.../S..., got {notation!r}")
    table = np.zeros(512, bool)
    for base, part in zip((0, 256), (parts[0][1:], parts[1][1:]), strict=True):
        i = 0
        while i < len(part):
            if part[i] not in "012345678":
                raise InvalidParams(f"a digit from 0 to 8 is wanted at {i} of {part!r}")
            n, j = int(part[i]), i + 1
            while j < len(part) and part[j].isascii() and part[j].islower():
                j += 1
            for letter in part[i + 1 : j] or [x for m, x in orbits() if m == n]:
                if (n, letter) not in orbits():
                    raise InvalidParams(f"no orbit {letter!r} with {n} neighbours")
                table[[base + p for p in orbits()[n, letter]]] = True
            i = j
    return table


def table_of_hex(digits: str) -> np.ndarray:
    """512 entries from 128 hexadecimal digits, the highest bit of each digit first."""
    digits = digits.removeprefix("0x")
    if len(digits) != 128 or any(d not in "0123456789abcdefABCDEF" for d in digits):
        raise InvalidParams("a look-up table has 128 hexadecimal digits")
    return np.array([int(d, 16) >> s & 1 for d in digits for s in (3, 2, 1, 0)], bool)


def table_of_items(items: list[int]) -> np.ndarray:
    if len(items) != 512 or any(x not in (0, 1) for x in items):
        raise InvalidParams("a look-up table has 512 items 0 or 1")
    return np.array(items, bool)


def with_preset(config: dict, dimension: int) -> dict:
    """config with its preset's rule in place of its own rule keys."""
    if "preset" not in config:
        return dict(config)
    if config["preset"] not in PRESETS[dimension]:
        raise InvalidParams(f"no preset {config['preset']!r} in {dimension} dimensions; give the rule itself")
    return {k: v for k, v in config.items() if k not in RULE_KEYS and k != "preset"} | PRESETS[dimension][config["preset"]]
