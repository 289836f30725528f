"""Expressions over a frame's cells. All but points_of stay inside the JVM; none explodes the array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from frameloom.errors import InvalidParams

#: The largest code point, and the sign that stands for code points no text can hold.
LAST_CODEPOINT, REPLACEMENT = 0x10FFFF, 0xFFFD


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def cells_as_int(state: Column, kind: str) -> Column:
    """Truth as 0 and 1; floats lose what stands after the point."""
    return state if kind == "int" else F.transform(state, lambda v: v.cast("bigint"))


def all_zero(state: Column) -> Column:
    """True for a frame without cells too."""
    return F.forall(state, lambda v: v.cast("double") == 0)


def _entropy(values: Column) -> Column:
    """Shannon entropy in bits of an array's values: runs of the sorted array, one pass."""
    n = F.size(values).cast("double")
    start = F.struct(F.lit(0.0).alias("bits"), F.lit(0).alias("run"), F.lit(None).cast("bigint").alias("last"))
    term = lambda run: F.when(run > 0, -(run / n) * F.log2(run / n)).otherwise(0.0)

    def step(acc, v):
        same = v == acc["last"]
        bits = F.when(same, acc["bits"]).otherwise(acc["bits"] + term(acc["run"]))
        return F.struct(bits.alias("bits"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"), v.cast("bigint").alias("last"))

    return F.aggregate(F.array_sort(values), start, step, lambda acc: acc["bits"] + term(acc["run"]))


def histogram_entropy(state: Column, kind: str = "int") -> Column:
    """Shannon entropy of |cell| mod 256 in bits, over 8; 0 without cells."""
    return let(F.transform(cells_as_int(state, kind), lambda v: F.abs(v % 256)), lambda bins: _entropy(bins) / 8)


def bin_entropy(state: Column, bins: int) -> Column:
    """Shannon entropy in bits of the cells 0 .. bins-1, others left out."""
    return let(F.filter(state, lambda v: (v >= 0) & (v < bins)), _entropy)


def scaled(v: Column, low: Column, high: Column, most: float, method: str = "Linear") -> Column:
    """A float cell between low and high as an integer from 0 to most, halves away from zero."""
    if method in ("Linear", "UniformQuantile"):  # the second is the first by definition
        x = (v - low) / (high - low) * most
    elif method == "LogBucket":
        x = F.log2(1 + F.abs(v)) / F.log2(1 + F.greatest(F.abs(low), F.abs(high))) * most
    else:
        raise InvalidParams(f"no method {method!r}")
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))).cast("bigint")


def difference(state: Column, before: Column, kind: str) -> Column:
    """Cell by cell, as far as both reach; truth values by exclusive or."""
    n = F.least(F.size(state), F.size(before))
    pair = (lambda a, b: a != b) if kind == "bool" else (lambda a, b: a - b)
    return F.zip_with(F.slice(state, 1, n), F.slice(before, 1, n), pair)


def codepoints(state: Column, kind: str, start: int) -> Column:
    """Cells as code points from start on."""
    if kind == "float":
        return F.transform(state, lambda v: F.lit(start) + F.least(F.greatest((v * 256).cast("bigint"), F.lit(0)), F.lit(255)))
    if kind == "bool":
        return F.transform(state, lambda v: F.lit(start) + v.cast("bigint"))
    # The bounds come first, so that the sum cannot overflow.
    return F.transform(state, lambda v: F.lit(start) + F.least(F.greatest(v, F.lit(-start)), F.lit(LAST_CODEPOINT - start)))


def patch_tokens(state: Column, patch: int, rows: int, cols: int, colours: int = 10, groups: int = 1, stride: int | None = None) -> Column:
    """Start token, one token for each patch (group by group, row by row), end token. A cell that is not there counts as 0."""
    if patch <= 0 or colours < 2 or groups < 1 or rows <= 0 or cols <= 0 or rows % patch or cols % patch:
        raise InvalidParams("patches must tile the grid, and there must be two colours at least")
    base = colours ** (patch * patch)
    if base + 1 > (1 << 63) - 1:
        raise InvalidParams("tokens of such patches do not fit 64 bits")
    step = patch if stride is None else stride
    if step <= 0:
        raise InvalidParams("stride must be positive")
    tokens = []
    for g in range(groups):
        for i in range(rows // patch):
            for j in range(cols // patch):
                terms = [F.coalesce(F.get(state, ((i * step + a) * cols + j * step + b) * groups + g), F.lit(0)) * (colours ** (a * patch + b)) for a in range(patch) for b in range(patch)]
                tokens.append(sum(terms[1:], terms[0]).cast("bigint"))
    return F.array(F.lit(base).cast("bigint"), *tokens, F.lit(base + 1).cast("bigint"))


def patch_cells(tokens: Column, patch: int, rows: int, cols: int, colours: int = 10) -> Column:
    """The grid that patch_tokens (one group, stride = patch) came from."""
    across = cols // patch
    cell = lambda r, c: F.call_function("div", F.get(tokens, 1 + (r // patch) * across + c // patch), F.lit(colours ** ((r % patch) * patch + c % patch))) % colours
    return F.array(*[cell(r, c).cast("bigint") for r in range(rows) for c in range(cols)])


def neighbour_agreement(state: Column, rows: int, cols: int) -> Column:
    """The mean of the shares of equal neighbours, across and down."""
    cell = lambda i: F.get(state, i)
    right = F.filter(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: (i % cols < cols - 1) & (cell(i) == cell(i + 1)))
    down = F.filter(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: (i < (rows - 1) * cols) & (cell(i) == cell(i + cols)))
    return (F.size(right) / float(rows * (cols - 1)) + F.size(down) / float((rows - 1) * cols)) / 2


def changed_share(state: Column, before: Column) -> Column:
    """The share of cells that differ, as far as both reach; null without a frame before."""
    n = F.least(F.size(state), F.size(before))
    same = F.zip_with(F.slice(state, 1, n), F.slice(before, 1, n), lambda a, b: a.eqNullSafe(b))
    return F.when(before.isNotNull(), F.size(F.filter(same, lambda s: ~s)) / n)


def first_largest(values: Column) -> Column:
    """The place, from 0, of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def softmax_pick(logits: Column, u: Column) -> Column:
    """The first place at which the cumulated softmax exceeds u, the last one if none does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))

    def picked(e: Column) -> Column:
        def count(total: Column) -> Column:
            step = lambda a, v: F.struct((a["sum"] + v / total).alias("sum"), F.when(u < a["sum"] + v / total, a["at"]).otherwise(a["at"] + 1).alias("at"))  # noqa: E731  sums only grow
            return F.aggregate(e, start, step, lambda a: F.least(a["at"], F.size(e) - 1))

        return let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), count)

    return let(let(F.array_max(logits), lambda most: F.transform(logits, lambda v: F.exp(v - most))), picked)


def layer(state: Column, index: int, size: int) -> Column:
    """One of several layers that follow each other."""
    return F.slice(state, index * size + 1, size)


def channel(state: Column, index: int, channels: int) -> Column:
    """One of several channels that alternate."""
    return F.filter(state, lambda v, i: i % channels == index)


def one_hot(cell: Column, states: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: (s == cell).cast("int"))


def padded(seq: Column, length: int, fill) -> Column:
    """Cut or filled up to length."""
    return F.slice(F.concat(seq, F.array_repeat(F.lit(fill).cast("bigint"), length)), 1, length)


def next_targets(seq: Column, ignore: int = -100, masked: int = 0) -> Column:
    """What follows each place; negative tokens, the first `masked` places and the end read as `ignore`."""
    shifted = F.concat(F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0))), F.array(F.lit(ignore).cast("bigint")))
    return F.transform(shifted, lambda v, i: F.when((v < 0) | (i < masked), F.lit(ignore)).otherwise(v).cast("bigint"))


def offset_tokens(state: Column, offset: int, start: int, end: int) -> Column:
    """Cells moved by a vocabulary's offset between a start and an end token."""
    return F.concat(F.array(F.lit(start).cast("bigint")), F.transform(state, lambda v: (v + offset).cast("bigint")), F.array(F.lit(end).cast("bigint")))


def decimal_digits(numbers: Column) -> Column:
    return F.transform(F.split(F.array_join(F.transform(numbers, lambda n: n.cast("string")), ""), ""), lambda d: d.cast("bigint"))


def counted_digits(first: Column, numbers: int) -> Column:
    """The digits of so many numbers in a row, from `first` on."""
    return decimal_digits(F.sequence(first, first + numbers - 1))


def text_of(state: Column, kind: str = "int") -> Column:
    """Cells as characters: truth as 0 and 1, floats as code points up to 255, what no text can hold as U+FFFD."""
    if kind == "bool":
        return F.array_join(F.transform(state, lambda v: F.when(v, "1").otherwise("0")), "")
    point = F.transform(state, (lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("bigint")) if kind == "float" else (lambda v: v.cast("bigint")))
    valid = lambda v: F.when((v < 0) | (v > LAST_CODEPOINT) | v.between(0xD800, 0xDFFF), F.lit(REPLACEMENT)).otherwise(v)
    return F.array_join(F.transform(point, lambda v: F.decode(F.unhex(F.lpad(F.hex(valid(v)), 8, "0")), "UTF-32")), "")


def points_of(text: Column) -> Column:
    """A text's code points; none for the empty text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), 256):  # eight bytes for each character: few rows at a time
                part = batch.slice(lo, 256)
                texts = part.to_pylist()
                ends = np.cumsum([0, *(len(t or "") for t in texts)]).astype(np.int32)
                points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4").astype(np.int64)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(points), mask=part.is_null())

    by_character = F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint")))
    return F.coalesce(F.arrow_udf(run, "array<bigint>")(F.when(F.is_valid_utf8(text), text)), by_character)  # bytes that are no UTF-8 would not reach Python


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 where fewer than k of n fail, else 1 - prod(1 - k / i) for i from n - c + 1 to n."""
    product = F.aggregate(F.sequence(F.greatest(n - c + 1, F.lit(1)).cast("int"), F.greatest(n, F.lit(1)).cast("int")), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.when(c == 0, F.lit(0.0)).otherwise(1 - product))


def dyck_valid(state: Column, symbols: int) -> Column:
    """Whether brackets (0 .. symbols-1 open, the same plus symbols close) match and none is left open."""
    start = F.struct(F.array().cast("array<bigint>").alias("stack"), F.lit(True).alias("ok"))

    def step(acc, v):
        empty = F.size(acc["stack"]) == 0
        opens = (v >= 0) & (v < symbols)
        fits = ~empty & (F.try_element_at(acc["stack"], F.lit(-1)) + symbols == v)
        pushed = F.concat(acc["stack"], F.array(v.cast("bigint")))
        popped = F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        return F.struct(F.when(opens, pushed).otherwise(F.when(fits, popped).otherwise(acc["stack"])).alias("stack"), (acc["ok"] & (opens | F.coalesce(fits, F.lit(False)))).alias("ok"))

    return F.aggregate(state, start, step, lambda a: a["ok"] & (F.size(a["stack"]) == 0))


def shuffle_dyck_valid(state: Column, symbols: int) -> Column:
    """Whether each symbol's brackets balance on their own, never closing more than are open."""
    def balanced(symbol: int) -> Column:
        closes = lambda v: F.when(v == symbol + symbols, 1).otherwise(0)
        step = lambda a, v: F.struct((a["open"] + F.when(v == symbol, 1).otherwise(0) - closes(v)).alias("open"), (a["ok"] & (a["open"] >= closes(v))).alias("ok"))
        return F.aggregate(state, F.struct(F.lit(0).alias("open"), F.lit(True).alias("ok")), step, lambda a: a["ok"] & (a["open"] == 0))

    ok = balanced(0)
    for symbol in range(1, symbols):
        ok = ok & balanced(symbol)
    return ok


def dyck_conditional(sequence: Column, prediction: Column, symbols: int, max_depth: int) -> Column:
    """How many predicted brackets are valid after the true ones up to their place: an opening one below max_depth, or one that
    closes the innermost open bracket. True brackets that do not fit change nothing."""
    start = F.struct(F.array().cast("array<bigint>").alias("stack"), F.lit(0).cast("bigint").alias("valid"))
    top = lambda stack: F.try_element_at(stack, F.lit(-1))

    def step(acc: Column, x: Column) -> Column:
        fits = F.coalesce(top(acc["stack"]) == x["s"] - symbols, F.lit(False))
        popped = F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        return F.struct(F.when(x["s"] < symbols, F.concat(acc["stack"], F.array(x["s"].cast("bigint")))).when(fits, popped).otherwise(acc["stack"]).alias("stack"), acc["valid"].alias("valid"), x["p"].alias("p"))

    def judge(acc: Column) -> Column:
        good = ((acc["p"] < symbols) & (F.size(acc["stack"]) < max_depth)) | F.coalesce(top(acc["stack"]) == acc["p"] - symbols, F.lit(False))
        return F.struct(acc["stack"].alias("stack"), (acc["valid"] + good.cast("bigint")).alias("valid"))

    return _folded(sequence, prediction, start, step, judge)


def shuffle_dyck_conditional(sequence: Column, prediction: Column, symbols: int, max_depth: int) -> Column:
    """The same for brackets whose kinds are counted on their own, each up to max_depth.

    At that depth a bracket of its kind closes, whichever way it points, in the sequence and in what is predicted.
    """
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), symbols).alias("stack"), F.lit(0).cast("bigint").alias("valid"))

    def step(acc: Column, x: Column) -> Column:
        opens = (x["s"] < symbols) & (F.get(acc["stack"], x["s"].cast("int")) < max_depth)
        moved = F.transform(acc["stack"], lambda n, i: F.when(i != F.pmod(x["s"], F.lit(symbols)), n).when(opens, n + 1).otherwise(F.greatest(n - 1, F.lit(0))))
        return F.struct(moved.alias("stack"), acc["valid"].alias("valid"), x["p"].alias("p"))

    def judge(acc: Column) -> Column:
        n = F.get(acc["stack"], F.pmod(acc["p"], F.lit(symbols)).cast("int"))
        good = ((acc["p"] < symbols) & (n < max_depth)) | (n > 0)
        return F.struct(acc["stack"].alias("stack"), (acc["valid"] + good.cast("bigint")).alias("valid"))

    return _folded(sequence, prediction, start, step, judge)


def _folded(sequence: Column, prediction: Column, start: Column, step, judge) -> Column:
    """The count after all places: at each the state takes in the true element, then the prediction is judged."""
    pairs = F.zip_with(sequence, prediction, lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    # One element, so that the state of a step is made once and named several times.
    return F.aggregate(pairs, start, lambda acc, x: F.element_at(F.transform(F.array(step(acc, x)), judge), 1), lambda acc: acc["valid"])


def equal_places(a: Column, b: Column) -> Column:
    """At how many places two arrays agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e)).cast("bigint")


def file_name(task: Column, shard: Column, seed: Column, extension: str) -> Column:
    return F.concat(task, F.lit("_"), F.lpad(shard.cast("string"), 5, "0"), F.lit("_"), F.lower(F.lpad(F.hex(seed), 16, "0")), F.lit("." + extension))


def human_bytes(n: Column) -> Column:
    """Bytes, KB, MB or GB with two digits."""
    unit = lambda size, name: F.concat(F.format_string("%.2f", F.bround(n / float(size), 2)), F.lit(" " + name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, "KB")).when(n < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def cut_at_first(text: Column, stops: list[str]) -> Column:
    """The text before the first of the stop strings."""
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = F.coalesce(at[0] if len(at) == 1 else F.least(*at), F.length(text) + 1)
    return F.substring(text, F.lit(1), first - 1)


def final_answer(text: Column, marker: str = "####") -> Column:
    """What follows the last marker, trimmed and without thousands commas; null without a marker."""
    return F.when(F.instr(text, marker) > 0, F.replace(F.trim(F.element_at(F.split(text, marker), -1)), F.lit(","), F.lit("")))


def same_answer(a: Column, b: Column) -> Column:
    """Equal but for case and blanks around."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def hue(state: Column, states: int) -> Column:
    """A colour (hexadecimal) for a state: black and white for two, fixed ones for four, else a wheel; magenta beyond."""
    if states == 2:
        return F.when(state == 0, "000000").when(state == 1, "ffffff").otherwise("ff00ff")
    h = state * (6.0 / states)
    part = lambda k: F.round(255 * (1 - F.greatest(F.least(F.least((F.lit(float(k)) + h) % 6, 4 - (F.lit(float(k)) + h) % 6), F.lit(1.0)), F.lit(0.0)))).cast("int")
    wheel = F.lower(F.concat(*[F.lpad(F.hex(part(k)), 2, "0") for k in (5, 3, 1)]))
    return F.when((state < 0) | (state >= states), "ff00ff").otherwise(wheel)


def count_at_most(sorted_values: Column, value: Column) -> Column:
    """How many values of a sorted array are at or below a value, by halving; null for null."""
    n = F.size(sorted_values)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        more = (acc["low"] < acc["high"]) & (F.get(sorted_values, middle) <= value)
        return F.struct(F.when(more, middle + 1).otherwise(acc["low"]).alias("low"), F.when(more, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

    return F.when(value.isNotNull(), F.when(n > 0, F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda acc: acc["low"])).otherwise(F.lit(0)))
