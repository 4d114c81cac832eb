"""Column functions. All are built from Spark's own expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest first sequence for which `lcs_length` fits 64-bit words.
LCS_BITS = 62


def six(c: Column) -> Column:
    """Rounded to six places; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def ids_text(c: Column | str) -> Column:
    """An array as comma-joined text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")


def lcs_masks(a: Column) -> Column:
    """Map from each value of `a` to a word with a bit for each of its positions. Make it a column of its own before using it
    in `lcs_length`: what stands inside a lambda is computed for every element."""
    numbered = F.transform(a, lambda x, i: F.struct(x.alias("x"), F.expr("1L").alias("one"), i.alias("i")))
    values = F.array_distinct(a)
    bits = F.transform(values, lambda v: F.aggregate(numbered, F.lit(0).cast("long"), lambda m, s: m + F.when(s["x"] == v, F.call_function("shiftleft", s["one"], s["i"])).otherwise(F.lit(0).cast("long"))))
    return F.map_from_arrays(values, bits)


def lcs_length(masks: Column, size_a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by a bit-parallel recurrence over the second sequence (first up to LCS_BITS).

    The state has a bit for each position of the first sequence; each step takes in one value of the second, and the cleared
    bits at the end are the length.
    """
    full = F.call_function("shiftleft", F.expr("1L"), size_a) - F.lit(1).cast("long")

    def step(v: Column, x: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.element_at(masks, x), F.lit(0).cast("long")))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    return (size_a - F.bit_count(F.aggregate(b, full, step))).cast("long")


def rouge_recall(lcs: Column, original: Column, other: Column) -> Column:
    """Common length over the original's; an empty original scores 1 against an empty sequence, else 0."""
    empty = F.when(F.size(other) == 0, 1.0).otherwise(0.0)
    return F.when(F.size(original) == 0, empty).otherwise(lcs / F.size(original))


def positional_accuracy(a: Column, b: Column) -> Column:
    """Share of positions with equal values; 0 if the lengths differ, or both are empty."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(0.0)


def nearest(x: Column, values: Column) -> Column:
    """The nearest of an array of values; of two equally near ones the lower."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))["v"]


def sorted_quantile(values: Column, q: Column) -> Column:
    """The quantile of a sorted array without nulls, linear between its entries."""
    at = (F.size(values) - 1) * q
    low, high = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (at - F.floor(at)) * (high - low)


def quantize(x: Column) -> Column:
    """Rounded half to even."""
    return F.rint(x).cast("int")


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(x, hi), lo)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """Scaled to 0..1; all zero if there is no range."""
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)


def denormalize(x: Column, lo: Column, hi: Column) -> Column:
    """The inverse; unchanged if there is no range."""
    return F.when(hi > lo, x * (hi - lo) + lo).otherwise(x)


def bucketize(x: Column, edges: list[float]) -> Column:
    """-1 for null and NaN, else how many edges are not above x."""
    out = F.when(x.isNull() | F.isnan(x), -1)
    for i, e in enumerate(edges):
        out = out.when(x < e, i)
    return out.otherwise(len(edges))


def multi_hot(ids: Column, classes: int) -> Column:
    """A 0/1 array over the classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(ids, i).cast("double"))


def step_embedding(t: Column, dim: int) -> Column:
    """Sines, then cosines, of t at falling frequencies; a zero more if dim is odd."""
    half = dim // 2
    freq = [math.exp(-i * math.log(10000.0) / (half - 1)) for i in range(half)]
    parts = [F.sin(t * f) for f in freq] + [F.cos(t * f) for f in freq] + [F.lit(0.0)] * (dim % 2)
    return F.array(*parts)


def interleaved_embedding(t: Column, dim: int) -> Column:
    """Sine and cosine side by side at each frequency."""
    parts = []
    for i in range(0, dim, 2):
        scale = 1.0 / 10000.0 ** (i / dim)
        parts += [F.sin(t * scale), F.cos(t * scale)]
    return F.array(*parts[:dim])


#: Calendar features by name: an integer expression, its least value and its range.
CALENDAR = {
    "second": (F.second, 0, 59),
    "minute": (F.minute, 0, 59),
    "hour": (F.hour, 0, 23),
    "weekday": (F.weekday, 0, 6),
    "day": (F.dayofmonth, 1, 30),
    "dayofyear": (F.dayofyear, 1, 365),
    "month": (F.month, 1, 11),
    "week": (F.weekofyear, 1, 52),
}
#: Features that make sense at each frequency, coarse ones first.
BY_FREQUENCY = {
    "Y": [],
    "Q": ["month"],
    "M": ["month"],
    "W": ["day", "week"],
    "D": ["weekday", "day", "dayofyear"],
    "B": ["weekday", "day", "dayofyear"],
    "H": ["hour", "weekday", "day", "dayofyear"],
    "T": ["minute", "hour", "weekday", "day", "dayofyear"],
    "S": ["second", "minute", "hour", "weekday", "day", "dayofyear"],
}


def add_time_feature(name: str, function: Callable[[Column], Column], least: float, span: float, frequencies: tuple[str, ...] = ()) -> None:
    """A calendar feature of the user's own, with the least value and the range that scale it, for some frequencies."""
    CALENDAR[name] = (function, least, span)
    for f in frequencies:
        if name not in BY_FREQUENCY[f]:
            BY_FREQUENCY[f].append(name)


def time_feature(ts: Column, name: str) -> Column:
    """A calendar feature scaled to -0.5..0.5."""
    f, least, span = CALENDAR[name]
    return (f(ts) - least) / float(span) - 0.5


def time_features(ts: Column, frequency: str) -> dict[str, Column]:
    """The features of a frequency such as `H`, `15T` or `D`."""
    unit = frequency.lstrip("0123456789").upper().removesuffix("IN") if frequency else ""
    unit = {"MIN": "T", "M": "M"}.get(unit, unit)
    if unit not in BY_FREQUENCY:
        raise ValueError(f"no time features for frequency {frequency!r}")
    return {n: time_feature(ts, n) for n in BY_FREQUENCY[unit]}


def array_split_bounds(n: Column, parts: Column, which: Column) -> tuple[Column, Column]:
    """[start, end) of one of `parts` parts of n positions, where the first n % parts are one longer."""
    base, extra = F.floor(n / parts), n % parts
    start = which * base + F.least(which, extra)
    return start, start + base + (which < extra).cast("long")


def gelu(x: Column) -> Column:
    """x times the normal distribution function at x, by a rational approximation of erf good to 1.5e-7."""
    a = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = (1.0 - poly * F.exp(-a * a)) * F.signum(x)
    return 0.5 * x * (1.0 + erf)


def activation(x: Column, name: str) -> Column:
    """identity, tanh, relu, gelu, silu (or swish), sigmoid."""
    sigmoid = 1.0 / (1.0 + F.exp(-x))
    table = {"identity": x, "tanh": F.tanh(x), "relu": F.greatest(x, F.lit(0.0)), "silu": x * sigmoid, "swish": x * sigmoid, "sigmoid": sigmoid, "gelu": gelu(x)}
    if name not in table:
        raise ValueError(f"no activation {name!r}")
    return table[name]
