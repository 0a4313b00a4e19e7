"""Operators whose result depends on all records before: filters, envelopes and expressions with registers.

Each is a ``scan``: records of a stream are taken in order, batch by batch, with a state of fixed size in between.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import evaluate, parse
from .order import scan


def _replaced(stream: DataFrame, by: str, start: Callable, step: Callable, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    return scan(stream, by, list(columns), "_new", start, step).withColumn("v", F.col("_new")).drop("_new")


# Second-order filters


def width_to_q(kind: str, width: float, f: float, rate: float, gain: float = 0.0) -> float:
    """Q of a width that is given as q, h (Hz), k (kHz), o (octaves) or s (the slope of a shelf)."""
    w0 = 2 * math.pi * f / rate
    if kind == "q":
        return width
    if kind in ("h", "k"):
        return f / (width * (1000 if kind == "k" else 1))
    if kind == "o":
        return 1 / (2 * math.sinh(math.log(2) / 2 * width * w0 / math.sin(w0)))
    if kind == "s":
        a = 10 ** (gain / 40)
        return 1 / math.sqrt((a + 1 / a) * (1 / width - 1) + 2)
    raise ValueError("a width is q, h, k, o or s")


def coefficients(kind: str, f: float, rate: float, width: float = 0.707, width_type: str = "q", gain: float = 0.0, poles: int = 2, csg: bool = False) -> tuple[float, ...]:
    """(b0, b1, b2, a1, a2) by the audio EQ cookbook, a0 divided out."""
    w0 = 2 * math.pi * min(f, rate * 0.4999) / rate
    c, s = math.cos(w0), math.sin(w0)
    if poles == 1 and kind in ("lowpass", "highpass"):
        a1 = -math.exp(-w0)
        return (1 + a1, 0.0, 0.0, a1, 0.0) if kind == "lowpass" else ((1 - a1) / 2, -(1 - a1) / 2, 0.0, a1, 0.0)
    q = width_to_q(width_type, width, f, rate, gain)
    alpha, a = s / (2 * q), 10 ** (gain / 40)
    r = 2 * math.sqrt(a) * alpha
    b, d = {
        "lowpass": lambda: (((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "highpass": lambda: (((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "bandpass": lambda: ((s / 2, 0.0, -s / 2) if csg else (alpha, 0.0, -alpha), (1 + alpha, -2 * c, 1 - alpha)),
        "bandreject": lambda: ((1.0, -2 * c, 1.0), (1 + alpha, -2 * c, 1 - alpha)),
        "allpass": lambda: ((1 - alpha, -2 * c, 1 + alpha), (1 + alpha, -2 * c, 1 - alpha)),
        "equalizer": lambda: ((1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)),
        "lowshelf": lambda: ((a * (a + 1 - (a - 1) * c + r), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - r)), (a + 1 + (a - 1) * c + r, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - r)),
        "highshelf": lambda: ((a * (a + 1 + (a - 1) * c + r), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - r)), (a + 1 - (a - 1) * c + r, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - r)),
    }[{"bass": "lowshelf", "treble": "highshelf"}.get(kind, kind)]()
    return (b[0] / d[0], b[1] / d[0], b[2] / d[0], d[1] / d[0], d[2] / d[0])


def _section(values: np.ndarray, c: tuple[float, ...], held: list[float]) -> list[float]:
    b0, b1, b2, a1, a2 = c
    z1, z2 = held
    out = []
    for x in values:
        y = b0 * x + z1
        z1 = b1 * x - a1 * y + z2
        z2 = b2 * x - a2 * y
        out.append(y)
    held[:] = z1, z2
    return out


def biquads(stream: DataFrame, by: str, sections: list[tuple[float, ...]], mix: float = 1.0) -> DataFrame:
    """Sections one after another; ``mix`` is the share of the result, the rest is the input. Null samples count as 0."""

    def step(state, arrays):
        x = np.nan_to_num(arrays[0], nan=0.0)
        y = x.tolist()
        for held, c in zip(state, sections, strict=True):
            y = _section(y, c, held)
        return state, np.asarray(y) * mix + x * (1 - mix)

    return _replaced(stream, by, lambda: [[0.0, 0.0] for _ in sections], step)


#: Frequency and width that each filter has by default.
DEFAULTS = {
    "lowpass": (500.0, 0.707), "highpass": (3000.0, 0.707), "bandpass": (3000.0, 0.5), "bandreject": (3000.0, 0.5), "allpass": (3000.0, 0.707), "equalizer": (1000.0, 1.0),
    "lowshelf": (100.0, 0.5), "bass": (100.0, 0.5), "highshelf": (3000.0, 0.5), "treble": (3000.0, 0.5), "tiltshelf": (3000.0, 0.5),
}


def equalize(stream: DataFrame, by: str, kind: str, rate: float, frequency: float | None = None, width: float | None = None, width_type: str = "q", gain: float = 0.0, poles: int = 2, csg: bool = False, mix: float = 1.0) -> DataFrame:
    """A filter of ``DEFAULTS`` by name. tiltshelf: a low shelf of minus half the gain, and a high shelf of half of it."""
    f, w = DEFAULTS[kind]
    f, w = frequency or f, width or w
    if kind == "tiltshelf":
        sections = [coefficients("lowshelf", f, rate, w, width_type, -gain / 2), coefficients("highshelf", f, rate, w, width_type, gain / 2)]
    else:
        sections = [coefficients(kind, f, rate, w, width_type, gain, poles, csg)]
    return biquads(stream, by, sections, mix)


def biquad(stream: DataFrame, by: str, a0: float = 1.0, a1: float = 0.0, a2: float = 0.0, b0: float = 1.0, b1: float = 0.0, b2: float = 0.0, mix: float = 1.0) -> DataFrame:
    return biquads(stream, by, [(b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0)], mix)


def anequalizer(stream: DataFrame, by: str, rate: float, bands: list[tuple[float, float, float]]) -> DataFrame:
    """Peaks of (frequency, width in Hz, gain in dB), one after another."""
    return biquads(stream, by, [coefficients("equalizer", f, rate, w, "h", g) for f, w, g in bands])


def k_weighting(rate: float) -> list[tuple[float, ...]]:
    """The two sections of the loudness measure: a high shelf, then a high-pass; constants as published for any rate."""
    f, g, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = math.tan(math.pi * f / rate)
    vh, vb = 10 ** (g / 20), (10 ** (g / 20)) ** 0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)]


# Envelopes and gains


def _db(x: float) -> float:
    return 20 * math.log10(x) if math.isfinite(x) and x > 1e-12 else -240.0


def _coeff(ms: float, rate: float) -> float:
    return 1 - math.exp(-1 / max(1.0, max(ms / 1000, 1e-6) * rate))


def gain_curve(level: float, threshold: float, ratio: float, knee: float, upward: bool = False) -> float:
    """dB of gain for a level in dB: none on one side of the threshold, ``ratio`` to 1 on the other, a parabola between."""
    d = threshold - level if upward else level - threshold
    if 2 * d <= -knee:
        y = d
    elif knee > 0 and 2 * abs(d) <= knee:
        y = d + (1 / ratio - 1) * (d + knee / 2) ** 2 / (2 * knee)
    else:
        y = d / ratio
    return max(0.0, d - y) if upward else min(0.0, y - d)


def dynamics(stream: DataFrame, by: str, rate: float, gain: Callable[[float], float], attack: float = 20.0, release: float = 250.0, detection: str = "rms", level_in: float = 1.0, level_sc: float = 1.0, makeup: float = 1.0, mix: float = 1.0, sidechain: str = "v") -> DataFrame:
    """Samples times a gain that depends on an envelope, of the samples themselves or of another column: ``gain`` maps its level in dB
    to dB. The envelope rises by ``attack`` and falls by ``release`` (ms); ``level_in`` counts for it as a power (rms) or an
    amplitude (peak)."""
    up, down = _coeff(attack, rate), _coeff(release, rate)
    heard = level_sc * (math.sqrt(level_in) if detection == "rms" else level_in)

    def step(state, arrays):
        out = []
        for x, s in zip(np.nan_to_num(arrays[0]).tolist(), np.nan_to_num(arrays[-1]).tolist(), strict=True):
            m = abs(s) * heard
            state += (m - state) * (up if m > state else down)
            wet = x * 10 ** (gain(_db(state)) / 20) * makeup
            out.append(x + mix * (wet - x))
        return state, np.array(out)

    return _replaced(stream, by, lambda: 0.0, step, ("v", sidechain) if sidechain != "v" else ("v",))


def acompressor(stream: DataFrame, by: str, rate: float, threshold: float = 0.125, ratio: float = 2.0, knee: float = 2.82843, upward: bool = False, **more) -> DataFrame:
    """Louder parts become quieter; ``sidechain`` names the column that decides."""
    return dynamics(stream, by, rate, lambda level: gain_curve(level, _db(threshold), ratio, _db(max(1.0, knee)), upward), **more)


def agate(stream: DataFrame, by: str, rate: float, threshold: float = 0.125, ratio: float = 2.0, knee: float = 2.82843, range: float = 0.06125, **more) -> DataFrame:
    """Parts below the threshold become quieter, by ``range`` at most."""
    return dynamics(stream, by, rate, lambda level: max(_db(range), -gain_curve(level, _db(threshold), ratio, _db(max(1.0, knee)), True) * ratio), **more)


def alimiter(stream: DataFrame, by: str, rate: float, limit: float = 1.0, attack: float = 5.0, release: float = 50.0, level_in: float = 1.0, level_out: float = 1.0) -> DataFrame:
    """Samples times limit over the peak envelope, where that is above ``limit``; cut at ``limit``."""
    up, down = _coeff(attack, rate), _coeff(release, rate)

    def step(state, arrays):
        out = []
        for x in (np.nan_to_num(arrays[0]) * level_in).tolist():
            m = abs(x)
            state += (m - state) * (up if m > state else down)
            out.append(max(-limit, min(limit, x * min(1.0, limit / state) if state > 0 else x)) * level_out)
        return state, np.array(out)

    return _replaced(stream, by, lambda: 0.0, step)


def transfer(points: list[tuple[float, float]], level: float) -> float:
    """dB out for dB in, linear between points, constant beyond them; unchanged without points."""
    if not points:
        return level
    xs, ys = zip(*sorted(points), strict=True)
    return float(np.interp(level, xs, ys))


def compand(stream: DataFrame, by: str, rate: float, points: list[tuple[float, float]], attack: float = 300.0, decay: float = 800.0, gain: float = 0.0, volume: float = 0.0) -> DataFrame:
    """Levels follow a curve of points (dB in, dB out); ``volume`` (dB) is the envelope before the first sample."""
    up, down = _coeff(attack, rate), _coeff(decay, rate)

    def step(state, arrays):
        out = []
        for x in np.nan_to_num(arrays[0]).tolist():
            m = abs(x)
            state += (m - state) * (up if m > state else down)
            level = _db(state)
            out.append(x * 10 ** ((transfer(points, level) + gain - level) / 20))
        return state, np.array(out)

    return _replaced(stream, by, lambda: 10 ** (volume / 20), step)


def speechnorm(stream: DataFrame, by: str, peak: float = 0.95, expansion: float = 2.0, compression: float = 2.0, rise: float = 0.001, fall: float = 0.001) -> DataFrame:
    """A gain moves by small steps towards what would bring each sample to ``peak``."""
    low = max(1e-6, 1 / max(compression, 1e-6))
    high = max(expansion, low)

    def step(state, arrays):
        out = []
        for x in np.nan_to_num(arrays[0]).tolist():
            goal = min(high, max(low, peak / abs(x))) if abs(x) > 1e-9 else high
            state = min(goal, state + rise) if goal > state else max(goal, state - fall)
            out.append(x * state)
        return state, np.array(out)

    return _replaced(stream, by, lambda: 1.0, step)


def adynamicsmooth(stream: DataFrame, by: str, rate: float, basefreq: float = 22050.0, sensitivity: float = 2.0) -> DataFrame:
    """Two low-passes, the faster the more these two differ."""
    t = math.tan(math.pi * min(max(basefreq, 2.0), rate * 0.499) / rate)
    base = t / (1 + t)

    def step(state, arrays):
        a, b = state
        out = []
        for x in np.nan_to_num(arrays[0]).tolist():
            g = min(1.0, base + sensitivity * abs(a - b))
            a += g * (x - a)
            b += g * (a - b)
            out.append(b)
        return (a, b), np.array(out)

    return _replaced(stream, by, lambda: (0.0, 0.0), step)


def dynaudnorm(blocks: DataFrame, by: str, gausssize: float = 31.0, peak: float = 0.95, maxgain: float = 10.0) -> DataFrame:
    """Adds ``gain`` to rows (by, pts, peak) of blocks: towards ``peak`` over the block's, smoothed from block to block."""
    alpha = 2 / (max(1.0, gausssize) + 1)

    def step(state, arrays):
        out = []
        for m in np.nan_to_num(arrays[0]).tolist():
            state += alpha * ((min(maxgain, peak / m) if m > 1e-9 else maxgain) - state)
            out.append(state)
        return state, np.array(out)

    return scan(blocks, by, ["peak"], "gain", lambda: 1.0, step)


def hqdn3d(stream: DataFrame, by: str, strength: float) -> DataFrame:
    """A temporal low-pass that follows large changes at once: the smaller the step, the more of the last result stays."""

    def step(state, arrays):
        out = []
        for x in arrays[0].tolist():
            if state is None or x != x:
                state = x if state is None else state
            else:
                keep = math.exp(-abs(x - state) / strength) if strength > 0 else 0.0
                state = x + keep * (state - x)
            out.append(state)
        return state, np.array(out, np.float64)

    return _replaced(stream, by, lambda: None, step)


def mpdecimate_runs(stream: DataFrame, by: str, high: float, most: int = 0) -> DataFrame:
    """Drops records within ``high`` of the last one kept, ``most`` in a row at the utmost (0: any number)."""

    def step(state, arrays):
        last, dropped = state
        out = []
        for x in arrays[0].tolist():
            goes = last is not None and abs(x - last) <= high and (not most or dropped < most)
            last, dropped = (last, dropped + 1) if goes else (x, 0)
            out.append(1.0 if goes else 0.0)
        return (last, dropped), np.array(out)

    return scan(stream, by, ["v"], "_gone", lambda: (None, 0), step).filter("_gone = 0").drop("_gone")


def evaluated(stream: DataFrame, by: str, expression: str, out: str = "x", names: dict[str, str] | None = None, seed: float = 0.0, now: float | None = None) -> DataFrame:
    """Adds ``out``: any expression, its registers carrying over from record to record of a stream. Variables: those that ``names``
    maps to columns (pts and v by default) and n. seed: what registers hold at first; now: what ``time`` gives (else the clock)."""
    import time

    columns = names or {"pts": "pts", "v": "v"}
    tree = parse(expression, {*columns, "n"})
    clock = time.time if now is None else lambda: now

    def step(state, arrays):
        registers, n = state
        found = []
        for values in zip(*[a.tolist() for a in arrays], strict=True):
            found.append(evaluate(tree, dict(zip(columns, values, strict=True)) | {"n": float(n)}, registers, clock))
            n += 1
        return (registers, n), np.array(found, np.float64)

    return scan(stream, by, list(columns.values()), out, lambda: ([seed] * 10, 0), step)

