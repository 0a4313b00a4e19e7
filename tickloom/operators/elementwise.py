"""Operators on single values, pairs of values and arrays of channels."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(x: Column, y: Column) -> Column:
    """x / y as IEEE 754 has it: over 0 infinite, or NaN if x is 0 as well; Spark's own division fails there."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / F.when(y != 0, y))


def _limit(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x.cast("long")))


def _split(test: Column, low: Column, high: Column) -> Column:
    return F.when(test < 128, low).otherwise(high)


def _low(a: Column, b: Column) -> Column:
    return F.floor(2 * a * b / 255)


def _high(a: Column, b: Column) -> Column:
    return 255 - F.floor(2 * (255 - a) * (255 - b) / 255)


#: Blend modes of 8-bit values a (the newer, or the first input) and b (the older, or the second).
BLEND: dict[str, Callable[[Column, Column], Column]] = {
    "addition": lambda a, b: a + b,
    "addition128": lambda a, b: a + b - 128,
    "and": lambda a, b: a.bitwiseAND(b),
    "average": lambda a, b: F.floor((a + b) / 2),
    "burn": lambda a, b: F.when(a == 0, 0).otherwise(255 - F.floor((255 - b) * 256 / F.when(a == 0, 1).otherwise(a))),
    "darken": lambda a, b: F.least(a, b),
    "difference": lambda a, b: F.abs(a - b),
    "difference128": lambda a, b: a - b + 128,
    "divide": lambda a, b: F.floor(256 * a / (b + 1) + 0.5),
    "dodge": lambda a, b: F.when(a >= 255, 255).otherwise(F.ceil(256 * b / (256 - a))),
    "exclusion": lambda a, b: a + b - F.floor(2 * a * b / 255),
    "hardlight": lambda a, b: _split(b, _low(a, b), _high(a, b)),
    "lighten": lambda a, b: F.greatest(a, b),
    "multiply": lambda a, b: F.floor(a * b / 255),
    "multiply128": lambda a, b: 128 + F.floor((a - 128) * b / 32),
    "negation": lambda a, b: 255 - F.abs(255 - a - b),
    "normal": lambda a, b: a,
    "or": lambda a, b: a.bitwiseOR(b),
    "overlay": lambda a, b: _split(a, _low(a, b), _high(a, b)),
    "screen": lambda a, b: 255 - F.floor((255 - a) * (255 - b) / 255),
    "subtract": lambda a, b: a - b,
    "xor": lambda a, b: a.bitwiseXOR(b),
}


def blend(mode: str, a: Column, b: Column) -> Column:
    """A blend mode, limited to 0..255."""
    return _limit(BLEND[mode](a.cast("long"), b.cast("long")))


def soft_clip(kind: str, x: Column, threshold: float = 1.0) -> Column:
    """Soft clipping; the threshold scales the curve."""
    u = x / threshold
    curve = {
        "hard": lambda: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u)),
        "erf": lambda: _erf(u),
        "tanh": lambda: F.tanh(u),
        "atan": lambda: F.atan(u) * (2 / 3.141592653589793),
        "cubic": lambda: F.when(F.abs(u) >= 1.5, F.signum(u)).otherwise(u - 4 / 27 * u * u * u),
        "alg": lambda: u / F.sqrt(1 + u * u),
        "exp": lambda: F.tanh(u),
        "quintic": lambda: F.when(F.abs(u) >= 1.25, F.signum(u)).otherwise(u - 0.08192 * u * u * u * u * u),
        "sin": lambda: F.when(F.abs(u) >= 3.141592653589793 / 2, F.signum(u)).otherwise(F.sin(u)),
    }[kind]
    return curve() * threshold


def gain(x: Column, db: float) -> Column:
    """An amplitude, louder by ``db`` decibels."""
    return x * 10 ** (db / 20)


def extrastereo(left: Column, right: Column, m: float) -> tuple[Column, Column]:
    """The difference of two channels is multiplied by ``m``."""
    mid = (left + right) / 2
    return mid + m * (left - mid), mid + m * (right - mid)


def pan(channels: Column, matrix: list[list[float]]) -> Column:
    """Output channels as sums of input channels: a row of ``matrix`` for each."""
    rows = [sum((channels[k] * c for k, c in enumerate(row) if c), F.lit(0.0)) for row in matrix]
    return F.array(*rows)


def _erf(x: Column) -> Column:
    """No built-in function has it."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(math.erf, na_action="ignore")

    return F.pandas_udf(each, "double")(x)


def mix(*inputs: Column, weights: list[float] | None = None, duration: str = "longest", normalize: bool = True) -> Column:
    """Weighted sums of the samples of several arrays, over the weights of those that go on there. duration: when the result
    ends, with the longest, the shortest or the first; an input that has ended counts no more, from that sample on."""
    w = [float(x) for x in (weights or [1.0] * len(inputs))]
    sizes = [F.size(c) for c in inputs]
    n = {"longest": F.greatest, "shortest": F.least, "first": lambda a, *_: a}[duration](*sizes) if len(inputs) > 1 else sizes[0]

    def sample(k: Column) -> Column:
        on = [k < size for size in sizes]
        total = sum((F.when(o, F.get(c, k) * x).otherwise(0.0) for o, c, x in zip(on, inputs, w, strict=True)), F.lit(0.0))
        scale = sum((F.when(o, abs(x)).otherwise(0.0) for o, x in zip(on, w, strict=True)), F.lit(0.0))
        return F.when(scale > 0, total / F.when(scale > 0, scale)).otherwise(0.0) if normalize else total

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(F.array().cast("array<double>"))
