"""The scalar expression language: parsed once on the driver, compiled to Catalyst columns.

Precedence, loosest first: ``;`` (the last value counts), ``+ -``, ``* /``, ``^`` (left-associative), signs. All values are
doubles with IEEE rules: division by zero gives an infinity or NaN, comparisons with NaN give 0, and a condition holds
where it isn't 0, NaN included. Expressions that keep state (``st``, ``ld``, ``random``) or that evaluate a part several times
(``while``, ``root``, ``taylor``) have no column form: ``operators.recursive.evaluated`` takes the records of a stream in order,
``evaluate`` takes one.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

CONSTANTS = {"PI": math.pi, "E": math.e, "PHI": (1 + math.sqrt(5)) / 2}
#: Decimal prefixes as powers of ten; an ``i`` after one makes it a power of 1024 or its inverse.
PREFIXES = {"y": -24, "z": -21, "a": -18, "f": -15, "p": -12, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "K": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18, "Z": 21, "Y": 24}
NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
NAME = re.compile(r"[A-Za-z_]\w*")
NAN, INF = float("nan"), float("inf")
STATEFUL = {"st", "ld", "while", "root", "random", "randomi", "print", "time", "taylor"}
ARITY = {
    "abs": (1, 1), "acos": (1, 1), "asin": (1, 1), "atan2": (2, 2), "atan": (1, 1), "between": (3, 3), "bitand": (2, 2), "bitor": (2, 2), "ceil": (1, 1), "clip": (3, 3),
    "cosh": (1, 1), "cos": (1, 1), "eq": (2, 2), "exp": (1, 1), "floor": (1, 1), "gauss": (1, 1), "gcd": (2, 2), "gte": (2, 2), "gt": (2, 2), "hypot": (2, 2), "ifnot": (2, 3),
    "if": (2, 3), "isinf": (1, 1), "isnan": (1, 1), "ld": (1, 1), "lerp": (3, 3), "log": (1, 1), "lte": (2, 2), "lt": (2, 2), "max": (2, 2), "min": (2, 2), "mod": (2, 2),
    "not": (1, 1), "pow": (2, 2), "print": (1, 3), "random": (1, 1), "randomi": (3, 3), "root": (2, 2), "round": (1, 1), "sgn": (1, 1), "sinh": (1, 1), "sin": (1, 1),
    "sqrt": (1, 1), "squish": (1, 1), "st": (2, 2), "tanh": (1, 1), "tan": (1, 1), "taylor": (2, 3), "time": (1, 1), "trunc": (1, 1), "while": (2, 2),
}


class ExprError(ValueError):
    """An expression that can't be read."""


class _Parser:
    def __init__(self, text: str, variables: set[str]):
        self.text, self.at, self.variables = "".join(text.split()), 0, variables

    def next_is(self, chars: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] in chars

    def sequence(self):
        parts = [self.sum()]
        while self.next_is(";"):
            self.at += 1
            parts.append(self.sum())
        return parts[0] if len(parts) == 1 else ("seq", *parts)

    def sum(self):
        left = self.product()
        while self.next_is("+-"):
            op = self.text[self.at]
            decibel = re.compile(r"\d+(?:\.\d*)?dB").match(self.text, self.at + 1)
            self.at += 1
            if op == "-" and decibel:  # the sign belongs to the decibels
                self.at = decibel.end()
                left = ("+", left, ("num", 10 ** (-float(decibel[0][:-2]) / 20)))
            else:
                left = (op, left, self.product())
        return left

    def product(self):
        left = self.signed()
        while self.next_is("*/"):
            op = self.text[self.at]
            self.at += 1
            left = (op, left, self.signed())
        return left

    def signed(self):
        if self.next_is("+-"):
            op = self.text[self.at]
            self.at += 1
            inner = self.signed()
            return inner if op == "+" else ("neg", inner)
        return self.power()

    def power(self):
        left = self.primary()
        while self.next_is("^"):
            self.at += 1
            sign = 1
            while self.next_is("+-"):
                sign = -sign if self.text[self.at] == "-" else sign
                self.at += 1
            right = self.primary()
            left = ("pow", left, right if sign > 0 else ("neg", right))
        return left

    def primary(self):
        if self.next_is("("):
            self.at += 1
            inner = self.sequence()
            if not self.next_is(")"):
                raise ExprError(f"missing ) at {self.at}")
            self.at += 1
            return inner
        if m := NUMBER.match(self.text, self.at):
            self.at = m.end()
            value = float(int(m[0], 16)) if m[0][:2].lower() == "0x" else float(m[0])
            return ("num", self.suffixed(value))
        if m := NAME.match(self.text, self.at):
            self.at = m.end()
            name = m[0]
            if self.next_is("("):
                return self.call(name)
            if name in self.variables:
                return ("var", name)
            if name in CONSTANTS:
                return ("num", CONSTANTS[name])
            raise ExprError(f"unknown name {name}")
        raise ExprError(f"nothing to read at {self.at} of {self.text!r}")

    def suffixed(self, value: float) -> float:
        if self.text.startswith("dB", self.at):
            self.at += 2
            return 10 ** (value / 20)
        if self.at < len(self.text) and self.text[self.at] in PREFIXES and not NAME.match(self.text, self.at + 1 + self.text.startswith("i", self.at + 1)):
            power = PREFIXES[self.text[self.at]]
            self.at += 1
            if self.next_is("i"):
                self.at += 1
                value *= 2.0 ** (power / 3 * 10)
            else:
                value *= 10.0**power
        if self.next_is("B"):
            self.at += 1
            value *= 8
        return value

    def call(self, name: str):
        if name not in ARITY:
            raise ExprError(f"unknown function {name}")
        self.at += 1
        args = []
        if not self.next_is(")"):
            args.append(self.sequence())
            while self.next_is(","):
                self.at += 1
                args.append(self.sequence())
        if not self.next_is(")"):
            raise ExprError(f"missing ) after {name}")
        self.at += 1
        low, high = ARITY[name]
        if not low <= len(args) <= high:
            raise ExprError(f"{name} takes {low} to {high} arguments")
        return (name, *args)


def parse(text: str, variables: set[str] | frozenset = frozenset()):
    """The tree of an expression: nested tuples. Raises ExprError where it can't be read whole."""
    p = _Parser(text, set(variables))
    tree = p.sequence()
    if p.at != len(p.text):
        raise ExprError(f"trailing text at {p.at} of {p.text!r}")
    return tree


def is_stateful(tree) -> bool:
    return tree[0] in STATEFUL or any(is_stateful(x) for x in tree[1:] if isinstance(x, tuple))


def uses(tree, name: str) -> bool:
    """Whether a variable occurs."""
    return tree == ("var", name) or any(uses(x, name) for x in tree[1:] if isinstance(x, tuple))


def _num(x: float) -> Column:
    return F.lit(x).cast("double")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _truth(x: Column) -> Column:
    return x != 0  # Spark's NaN differs from 0, too


def _divide(x: Column, y: Column) -> Column:
    zero = F.when(F.isnan(x) | (x == 0), _num(NAN)).when(x > 0, _num(INF)).otherwise(_num(-INF))
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, _num(1.0)).otherwise(y))


def _ordered(x: Column, y: Column, c: Column) -> Column:
    return _flag(c & ~F.isnan(x) & ~F.isnan(y))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(F.isnan(low) | F.isnan(high) | (low > high), _num(NAN)).when(F.isnan(x), x).when(x < low, low).when(x > high, high).otherwise(x)


def _whole(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a number that has a fraction; from 2 ** 53 on there is none, and NaN and infinities stay."""
    return F.when(F.abs(x) < 2.0**53, f(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)


def _long(x: Column) -> Column:
    """Cut to 64 bits, at the ends where it doesn't fit; NaN becomes 0."""
    return F.when(F.isnan(x), 0).when(x >= 2.0**63, (1 << 63) - 1).when(x <= -(2.0**63), -(1 << 63)).otherwise(F.when(F.abs(x) < 2.0**63, x).otherwise(0.0).cast("long"))


def _bits(x: Column, y: Column, f) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), _num(NAN)).otherwise(f(_long(x), _long(y)).cast("double"))


def _gcd_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # a zero gives the other operand as it is, its sign included
    return np.where(a == 0, b, np.where(b == 0, a, np.gcd(np.maximum(a, 1 - (1 << 63)), np.maximum(b, 1 - (1 << 63))))).astype(np.float64)


def _gcd(x: Column, y: Column) -> Column:
    """No built-in function has it, and a chain of remainders for 64 bits would be evaluated whole for each row."""
    ship(SparkSession.active())

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_gcd_array(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(each, "double")(_long(x), _long(y))


COLUMNS: dict[str, Callable] = {
    "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": _divide, "neg": lambda x: -x, "seq": lambda *x: x[-1],
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan2": F.atan2, "atan": F.atan, "cosh": F.cosh, "cos": F.cos, "exp": F.exp, "sinh": F.sinh, "sin": F.sin,
    "sqrt": F.sqrt, "tanh": F.tanh, "tan": F.tan, "hypot": F.hypot, "pow": F.pow, "isnan": lambda x: _flag(F.isnan(x)), "isinf": lambda x: _flag(x.isin(INF, -INF)),
    "between": lambda x, y, z: _flag((x >= y) & (x <= z) & ~F.isnan(x) & ~F.isnan(y) & ~F.isnan(z)),
    "bitand": lambda x, y: _bits(x, y, lambda a, b: a.bitwiseAND(b)), "bitor": lambda x, y: _bits(x, y, lambda a, b: a.bitwiseOR(b)),
    "ceil": lambda x: _whole(x, F.ceil), "floor": lambda x: _whole(x, F.floor), "round": lambda x: _whole(x, F.round), "trunc": lambda x: _whole(x, lambda v: F.signum(v) * F.floor(F.abs(v))),
    "clip": _clip, "eq": lambda x, y: _ordered(x, y, x == y), "gt": lambda x, y: _ordered(x, y, x > y), "gte": lambda x, y: _ordered(x, y, x >= y),
    "lt": lambda x, y: _ordered(x, y, x < y), "lte": lambda x, y: _ordered(x, y, x <= y), "gauss": lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi), "gcd": _gcd,
    "if": lambda c, a, b=None: F.when(_truth(c), a).otherwise(_num(0.0) if b is None else b), "ifnot": lambda c, a, b=None: F.when(_truth(c), _num(0.0) if b is None else b).otherwise(a),
    "lerp": lambda x, y, z: x + z * (y - x), "log": lambda x: F.when(x == 0, _num(-INF)).when(x < 0, _num(NAN)).otherwise(F.ln(x)),
    "max": lambda x, y: F.when((x > y) & ~F.isnan(x) & ~F.isnan(y), x).otherwise(y), "min": lambda x, y: F.when((x < y) & ~F.isnan(x) & ~F.isnan(y), x).otherwise(y),
    "mod": lambda x, y: x - _whole(_divide(x, y), F.floor) * y, "not": lambda x: _flag(x == 0), "sgn": lambda x: F.when(F.isnan(x), 0.0).otherwise(F.signum(x)), "print": lambda x, *_: x, "squish": lambda x: 1 / (1 + F.exp(4 * x)),
}


def to_column(text: str, variables: dict[str, Column] | None = None) -> Column:
    """The expression as a column; ``variables`` gives each name's column. Null variables count as NaN."""
    bound = {k: F.coalesce(v.cast("double"), _num(NAN)) for k, v in (variables or {}).items()}

    def build(tree) -> Column:
        if tree[0] == "num":
            return _num(tree[1])
        if tree[0] == "var":
            return bound[tree[1]]
        if tree[0] not in COLUMNS:
            raise ExprError(f"{tree[0]} keeps state: use evaluate()")
        return COLUMNS[tree[0]](*map(build, tree[1:]))

    return build(parse(text, set(bound)))


def condition(text: str, variables: dict[str, Column] | None = None) -> Column:
    """Whether the expression holds: it isn't 0."""
    return _truth(to_column(text, variables))


#: How often a loop goes round at most, in one evaluation.
ROUNDS = 100_000


def evaluate(tree, values: dict[str, float], registers: list[float], now: Callable[[], float] = time.time, functions: dict[str, Callable] | None = None) -> float:
    """One evaluation of any expression, in Python; ``registers`` (ten) carry over to the next one. now: what ``time`` gives;
    functions: the caller's own, by name."""
    go = lambda t: evaluate(t, values, registers, now, functions)
    kind, args = tree[0], tree[1:]
    if kind == "num":
        return args[0]
    if kind == "var":
        return values[args[0]]
    if functions and kind in functions:
        return float(functions[kind](*map(go, args)))
    register = lambda x: 0 if x != x else int(min(9.0, max(0.0, x)))
    if kind in ("if", "ifnot"):
        holds = (go(args[0]) != 0) == (kind == "if")
        return go(args[1]) if holds else go(args[2]) if len(args) > 2 else 0.0
    if kind == "while":
        last = NAN
        for _ in range(ROUNDS):
            if go(args[0]) == 0:
                break
            last = go(args[1])
        return last
    if kind == "st":
        k = register(go(args[0]))
        registers[k] = value = go(args[1])
        return value
    if kind == "ld":
        return registers[register(go(args[0]))]
    if kind == "root":
        return _root(args[0], go(args[1]), registers, go)
    if kind == "taylor":
        return _taylor(args[0], go(args[1]), register(go(args[2])) if len(args) > 2 else 0, registers, go)
    if kind in ("random", "randomi"):
        x = _random(register(go(args[0])), registers)
        if kind == "random":
            return x
        low, high = go(args[1]), go(args[2])
        return low + (high - low) * x
    if kind == "time":
        go(args[0])
        return now()
    return _python(kind, [go(a) for a in args])


def _random(k: int, registers: list[float]) -> float:
    """A linear congruential generator of 64 bits, whose state is a register; a share of the greatest state."""
    old = registers[k]
    seed = 0 if old != old else int(min(max(old, 0.0), 2.0**64 - 1)) if old < 2.0**64 else (1 << 64) - 1
    new = (seed * 1_664_525 + 1_013_904_223) & ((1 << 64) - 1)
    registers[k] = float(new)
    return float(new) / 18_446_744_073_709_551_615.0


def _taylor(body, x: float, k: int, registers: list[float], go: Callable) -> float:
    """The sum of body(i) x^i / i!, the register ``k`` holding i; it gets its old value back."""
    old, term, total = registers[k], 1.0, 0.0
    for i in range(1000):
        registers[k] = float(i)
        total += term * go(body)
        term *= x / (i + 1)
        if term == 0:
            break
    registers[k] = old
    return total


def _root(body, limit: float, registers: list[float], go: Callable) -> float:
    """Where body(ld(0)) is 0, by secants from 0 and ``limit``; register 0 gets its old value back."""
    old = registers[0]

    def f(x: float) -> float:
        registers[0] = x
        return go(body)

    a, b = 0.0, limit
    fa, fb = f(a), f(b)
    for _ in range(1000):
        if fa == fb:
            break
        c = b - fb * (b - a) / (fb - fa)
        if not math.isfinite(c) or c == b:
            break
        a, fa, b, fb = b, fb, c, f(c)
    registers[0] = old
    return b


def _whole_python(f: Callable[[float], float]) -> Callable[[float], float]:
    return lambda a: a if not abs(a) < 2.0**53 else float(f(a))


def _long_python(a: float) -> int:
    return 0 if a != a else min((1 << 63) - 1, max(-(1 << 63), int(a))) if abs(a) != INF else ((1 << 63) - 1 if a > 0 else -(1 << 63))


def _gcd_python(a: float, b: float) -> float:
    x, y = _long_python(a), _long_python(b)
    return float(math.gcd(x, y) if x and y else x or y)


def _divide_python(a: float, b: float) -> float:
    return a / b if b else NAN if a == 0 or a != a else math.copysign(INF, a) * math.copysign(1, b)


def _pair_bits(f: Callable[[int, int], int]) -> Callable[[float, float], float]:
    return lambda a, b: NAN if a != a or b != b else float(f(_long_python(a), _long_python(b)))


_FLOOR = _whole_python(math.floor)
PYTHON: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide_python, "neg": lambda a: -a, "seq": lambda *a: a[-1], "abs": abs,
    "eq": lambda a, b: float(a == b), "gt": lambda a, b: float(a > b), "gte": lambda a, b: float(a >= b), "lt": lambda a, b: float(a < b), "lte": lambda a, b: float(a <= b),
    "max": lambda a, b: a if a > b else b, "min": lambda a, b: a if a < b else b, "mod": lambda a, b: a - _FLOOR(_divide_python(a, b)) * b, "not": lambda a: float(a == 0),
    "between": lambda a, b, c: float(b <= a <= c), "floor": _FLOOR, "ceil": _whole_python(math.ceil), "trunc": _whole_python(math.trunc),
    "round": _whole_python(lambda a: math.copysign(math.floor(abs(a) + 0.5), a)), "lerp": lambda a, b, c: a + c * (b - a), "pow": math.pow, "sgn": lambda a: float((a > 0) - (a < 0)),
    "squish": lambda a: 1 / (1 + math.exp(4 * a)), "gauss": lambda a: math.exp(-a * a / 2) / math.sqrt(2 * math.pi), "clip": lambda a, b, c: (b if a < b else c if a > c else a) if b <= c else NAN,
    "isnan": lambda a: float(a != a), "isinf": lambda a: float(a in (INF, -INF)), "gcd": _gcd_python, "bitand": _pair_bits(lambda a, b: a & b), "bitor": _pair_bits(lambda a, b: a | b),
    "log": lambda a: -INF if a == 0 else math.log(a), "print": lambda a, *_: a,
}


def _python(kind: str, x: list[float]) -> float:
    try:
        return float((PYTHON.get(kind) or getattr(math, kind))(*x))
    except (ValueError, ZeroDivisionError):
        return NAN
    except OverflowError:
        return 0.0 if kind == "squish" else -INF if kind in ("sinh",) and x[0] < 0 else INF
