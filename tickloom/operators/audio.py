"""Audio effects without recursion, as window and scalar expressions.

A mono stream has the sample in ``v``, a stereo stream in ``l`` and ``r``; samples are ordered as in ``order``. Delays count
samples. What needs a recursion is in ``recursive``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import to_column
from .elementwise import quotient
from .order import numbered, ordered, tie


def _lagged(stream: DataFrame, by: str, column: str, samples: int) -> Column:
    """The sample so many places before, 0 before the first."""
    return F.col(column) if samples == 0 else F.coalesce(F.lag(column, samples).over(ordered(by, *tie(stream))), F.lit(0.0))


def _held(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def acrusher(x: Column, bits: float = 8.0, mix: float = 0.5, level_in: float = 1.0, level_out: float = 1.0) -> Column:
    """Samples on a grid of 2 ** bits - 1 steps, halves away from zero; ``mix`` 1 is all dry, 0 all wet."""
    levels = max(1.0, 2 ** min(64.0, max(1.0, bits)) - 1)
    dry = x * level_in
    wet = F.signum(dry) * F.floor(F.abs(dry) * levels + 0.5) / levels * level_out
    return wet + mix * (dry - wet)


def dcshift(x: Column, shift: float = 0.0, limitergain: float = 0.0) -> Column:
    """A constant is added; what leaves -1..1 is cut or, with a limiter gain, approaches full scale softly."""
    raw = x + shift
    if limitergain <= 0:
        return _held(raw)
    rate = min(1.0, max(1e-6, limitergain))
    return F.when(F.abs(raw) <= 1, raw).otherwise(F.signum(raw) * _held(1 - F.exp(-(F.abs(raw) - 1) / rate) * rate, 0.0))


def crystalizer(stream: DataFrame, by: str, i: float = 2.0, clip: bool = True) -> DataFrame:
    """The difference to the sample before is added ``i`` times."""
    y = F.col("v") + i * (F.col("v") - _lagged(stream, by, "v", 1))
    return stream.withColumn("v", _held(y) if clip else y)


def adelay(stream: DataFrame, by: str, samples: int) -> DataFrame:
    return stream.withColumn("v", _lagged(stream, by, "v", samples))


def delay_of(distance: float, temperature: float = 20.0, rate: int = 44_100) -> int:
    """Whole samples that sound takes for a distance in metres, at a temperature in degrees Celsius."""
    return math.floor(distance / (331.3 * math.sqrt(1 + temperature / 273.15)) * rate)


def compensationdelay(stream: DataFrame, by: str, distance: float, temp: float = 20.0, dry: float = 0.0, wet: float = 1.0, rate: int = 44_100) -> DataFrame:
    return stream.withColumn("v", dry * F.col("v") + wet * _lagged(stream, by, "v", delay_of(distance, temp, rate)))


def aecho(stream: DataFrame, by: str, delays: list[int], decays: list[float], in_gain: float = 0.6, out_gain: float = 0.3) -> DataFrame:
    """The sample and delayed copies of it, not fed back."""
    echoes = sum((decay * _lagged(stream, by, "v", d) for d, decay in zip(delays, decays, strict=True)), in_gain * F.col("v"))
    return stream.withColumn("v", out_gain * echoes)


def fir(stream: DataFrame, by: str, taps: list[float]) -> DataFrame:
    """The sum of the last samples, the newest by the first tap."""
    if len(taps) <= 64:
        return stream.withColumn("v", sum((c * _lagged(stream, by, "v", k) for k, c in enumerate(taps)), F.lit(0.0)))
    held = F.collect_list("v").over(ordered(by, *tie(stream)).rowsBetween(1 - len(taps), 0))
    weights = F.array(*map(F.lit, map(float, taps)))
    out = stream.withColumn("_held", F.reverse(held))
    total = F.aggregate(F.zip_with("_held", F.slice(weights, 1, F.size("_held")), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("v", total).drop("_held")


def equalizer_taps(bands: list[tuple[float, float]], rate: int, size: int = 63) -> list[float]:
    """Taps of a linear-phase filter that has the gains (dB) of ``bands`` at their frequencies, linear between and constant beyond, by
    frequency sampling and a Hann window."""
    points = sorted(bands)

    def gain(f: float) -> float:
        if f <= points[0][0]:
            db = points[0][1]
        elif f >= points[-1][0]:
            db = points[-1][1]
        else:
            (a, x), (b, y) = next((p, q) for p, q in zip(points, points[1:], strict=False) if p[0] <= f <= q[0])
            db = x + (y - x) * (f - a) / (b - a)
        return 10 ** (db / 20)

    n, half = 512, size // 2
    steps = [gain(k * rate / (2 * n)) for k in range(n + 1)]
    taps = []
    for t in range(-half, half + 1):
        total = steps[0] + steps[n] * math.cos(math.pi * t) + 2 * sum(steps[k] * math.cos(math.pi * k * t / n) for k in range(1, n))
        taps.append(total / (2 * n) * (0.5 + 0.5 * math.cos(math.pi * t / (half + 1))))
    return taps


def firequalizer(stream: DataFrame, by: str, bands: list[tuple[float, float]], rate: int, size: int = 63) -> DataFrame:
    return fir(stream, by, equalizer_taps(bands, rate, size))


#: Centres of the bands, in Hz.
BANDS = (65, 92, 131, 185, 262, 370, 523, 740, 1047, 1480, 2093, 2960, 4186, 5920, 8372, 11840, 16744, 20000)


def superequalizer(stream: DataFrame, by: str, gains: list[float], rate: int, size: int = 63) -> DataFrame:
    """Eighteen bands, each with a factor."""
    return firequalizer(stream, by, [(f, 20 * math.log10(max(g, 1e-6))) for f, g in zip(BANDS, gains, strict=True)], rate, size)


def tremolo(stream: DataFrame, by: str, rate: float, f: float = 5.0, d: float = 0.5) -> DataFrame:
    """Loudness goes down by ``d`` and back, ``f`` times a second; it starts at its greatest."""
    n = numbered(stream, by)
    return n.withColumn("v", F.col("v") * (1 - d * (0.5 - 0.5 * F.cos(2 * math.pi * f * F.col("_n") / rate)))).drop("_n")


def apulsator(stream: DataFrame, by: str, rate: float, hz: float = 2.0, amount: float = 1.0, offset_l: float = 0.0, offset_r: float = 0.5, level_in: float = 1.0, level_out: float = 1.0) -> DataFrame:
    """Both channels pulsate by sines with phases of their own."""
    n = numbered(stream, by)
    base = lambda offset: 0.5 + 0.5 * F.sin(2 * math.pi * (hz * F.col("_n") / rate + offset))
    gain = lambda offset: level_in * level_out * (1 - amount * (1 - base(offset)))
    return n.withColumns({"l": F.col("l") * gain(offset_l), "r": F.col("r") * gain(offset_r)}).drop("_n")


def modulated(stream: DataFrame, by: str, delay: Column, dry: float = 0.0, wet: float = 1.0, most: int = 64) -> DataFrame:
    """The sample ``delay`` (a column of ``_n``, in samples, 0 to ``most``) before, linear between samples; 0 before the first."""
    n = numbered(stream, by)
    held = F.collect_list("v").over(ordered(by, *tie(stream)).rowsBetween(-most - 1, 0))
    n = n.withColumn("_held", F.reverse(held)).withColumn("_d", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), delay)))
    at = lambda k: F.coalesce(F.get("_held", k.cast("int")), F.lit(0.0))
    low = F.floor("_d")
    found = at(low) * (1 - (F.col("_d") - low)) + at(low + 1) * (F.col("_d") - low)
    return n.withColumn("v", dry * F.col("v") + wet * found).drop("_n", "_held", "_d")


def vibrato(stream: DataFrame, by: str, rate: float, f: float = 5.0, d: float = 0.5, most: int = 64) -> DataFrame:
    """The delay swings by a sine between 0 and ``d`` of ``most`` samples."""
    return modulated(stream, by, d * most * (0.5 + 0.5 * F.sin(2 * math.pi * f * F.col("_n") / rate)), most=most)


def chorus(stream: DataFrame, by: str, rate: float, delays: list[float], decays: list[float], speeds: list[float], depths: list[float], in_gain: float = 0.4, out_gain: float = 0.4, most: int = 64) -> DataFrame:
    """Delayed voices, each swinging by its own depth (samples) and speed."""
    out = stream.withColumn("_x", F.col("v")).withColumn("_sum", in_gain * F.col("v"))
    for delay, decay, speed, depth in zip(delays, decays, speeds, depths, strict=True):
        voice = modulated(out.withColumn("v", F.col("_x")), by, delay + depth * F.sin(2 * math.pi * speed * F.col("_n") / rate), most=most)
        out = voice.withColumn("_sum", F.col("_sum") + decay * F.col("v"))
    return out.withColumn("v", F.col("_sum") * out_gain).drop("_x", "_sum")


def flanger(stream: DataFrame, by: str, rate: float, delay: float = 0.0, depth: float = 2.0, width: float = 71.0, speed: float = 0.5, most: int = 64) -> DataFrame:
    """A copy whose delay swings by ``depth`` samples above ``delay`` is added, ``width`` per cent of it, without feedback."""
    w = width / 100
    return modulated(stream, by, delay + depth * (0.5 + 0.5 * F.sin(2 * math.pi * speed * F.col("_n") / rate)), 1 / (1 + w), w / (1 + w), most)


# Stereo


def dialoguenhance(left: Column, right: Column, original: float = 1.0, enhance: float = 1.0) -> tuple[Column, Column]:
    """What both channels share is added ``enhance`` - 1 times."""
    more = (enhance - 1) * (left + right) / 2
    return original * left + more, original * right + more


def stereowiden(stream: DataFrame, by: str, delay: int, feedback: float = 0.3, crossfeed: float = 0.3, drymix: float = 0.8) -> DataFrame:
    """Less of the other channel, now and ``delay`` samples before."""
    l, r = F.col("l"), F.col("r")  # noqa: E741
    new = {
        "l": drymix * l - crossfeed * r - feedback * _lagged(stream, by, "r", delay),
        "r": drymix * r - crossfeed * l - feedback * _lagged(stream, by, "l", delay),
    }
    return stream.withColumns(new)


#: What each mode makes of two channels; ms: they hold middle and side.
STEREO_MODES = {
    "lr>lr": lambda l, r: (l, r), "lr>ms": lambda l, r: ((l + r) / 2, (l - r) / 2), "ms>lr": lambda l, r: (l + r, l - r), "lr>ll": lambda l, r: (l, l),
    "lr>rr": lambda l, r: (r, r), "lr>l+r": lambda l, r: ((l + r) / 2, (l + r) / 2), "lr>rl": lambda l, r: (r, l), "ms>ll": lambda l, r: (l + r, l + r),
    "ms>rr": lambda l, r: (l - r, l - r), "ms>rl": lambda l, r: (l - r, l + r), "lr>l-r": lambda l, r: ((l - r) / 2, (l - r) / 2),
}


def stereotools(left: Column, right: Column, mode: str = "lr>lr", level_in: float = 1.0, level_out: float = 1.0, balance_in: float = 0.0, balance_out: float = 0.0, mutel: bool = False, muter: bool = False, phasel: bool = False, phaser: bool = False) -> tuple[Column, Column]:
    """Levels, balance (positive: less left), a mode, muting and phase, in this order."""
    balance = lambda l, r, b: (l * (1 - b), r) if b > 0 else (l, r * (1 + b))
    l, r = balance(left * level_in, right * level_in, balance_in)
    l, r = balance(*STEREO_MODES[mode](l, r), balance_out)
    signs = [0.0 if mute else level_out * (-1 if phase else 1) for mute, phase in ((mutel, phasel), (muter, phaser))]
    return l * signs[0], r * signs[1]


def haas(stream: DataFrame, by: str, left_delay: int, right_delay: int, left_gain: float = 1.0, right_gain: float = 1.0, left_phase: bool = False, right_phase: bool = False, side_gain: float = 1.0, level_in: float = 1.0, level_out: float = 1.0) -> DataFrame:
    """The middle of both channels, delayed for each side on its own."""
    mid = stream.withColumn("_m", (F.col("l") + F.col("r")) / 2 * level_in)
    side = lambda d, g, phase: _lagged(mid, by, "_m", d) * (g * side_gain * level_out * (-1 if phase else 1))
    return mid.withColumns({"l": side(left_delay, left_gain, left_phase), "r": side(right_delay, right_gain, right_phase)}).drop("_m")


def aphasemeter(stream: DataFrame, by: str, block: int) -> DataFrame:
    """(by, block, phase): the correlation of both channels, from -1 to 1, of each block of samples; 0 for silence."""
    n = numbered(stream, by).withColumn("block", F.floor(F.col("_n") / block))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    den = F.sqrt(F.sum(l * l) * F.sum(r * r))
    return n.groupBy(by, "block").agg(F.when(den > 0, F.sum(l * r) / den).otherwise(0.0).alias("phase"))


def axcorrelate(pairs: DataFrame, by: str, size: int = 256, plain: bool = False) -> DataFrame:
    """Adds ``c``: the normalised product of a and b over the last ``size`` pairs, from -1 to 1; 0 for silence.

    plain: the quotient as it is, not held within that range by a last digit, and NaN for silence."""
    w = Window.partitionBy(by).orderBy("n").rowsBetween(1 - size, 0)
    a, b = F.col("a"), F.col("b")
    den = F.sqrt(F.sum(a * a).over(w) * F.sum(b * b).over(w))
    both = F.sum(a * b).over(w)
    if plain:
        return pairs.withColumn("c", quotient(both, den))
    return pairs.withColumn("c", F.when(den > 0, _held(both / F.when(den > 0, den))).otherwise(0.0))


# Channels as arrays


def amerge(*channels: Column) -> Column:
    """Channels of several inputs, one after another."""
    return F.concat(*channels)


def channelmap(channels: Column, order: list[int]) -> Column:
    return F.array(*[F.get(channels, F.lit(k)) for k in order])


def join(mapping: list[tuple[Column, int]]) -> Column:
    """A channel of an input for each output channel; 0 where there is none."""
    return F.array(*[F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) for c, k in mapping])


def asetnsamples(stream: DataFrame, by: str, size: int, pad: bool = True) -> DataFrame:
    """(by, block, samples): blocks of ``size`` samples; the last one is filled with zeros (``pad``) or shorter."""
    n = numbered(stream, by).withColumn("block", F.floor(F.col("_n") / size))
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("v").alias("v")))), lambda x: x["v"])
    out = n.groupBy(by, "block").agg(held.alias("samples"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(size) - F.size("samples"))
    return out.withColumn("samples", F.concat("samples", zeros)) if pad else out


def atrim_block(start: Column, samples: Column, first: int, last: int) -> tuple[Column, Column]:
    """(start, samples) of what of a block that starts at the sample ``start`` lies in first <= place < last; empty if nothing does."""
    low = F.greatest(F.lit(0), first - start)
    n = F.greatest(F.lit(0), F.least(F.size(samples).cast("long"), last - start) - low)
    return start + low, F.slice(samples, (low + 1).cast("int"), n.cast("int"))


# Levels


def volumedetect(stream: DataFrame, by: str) -> DataFrame:
    """(by, n_samples, mean_volume, max_volume): in dB."""
    db = lambda x, f: F.when(x > 0, f * F.log10(x)).otherwise(F.lit(float("-inf")))
    return stream.groupBy(by).agg(F.count("v").alias("n_samples"), db(F.avg(F.col("v") * F.col("v")), 10).alias("mean_volume"), db(F.max(F.abs("v")), 20).alias("max_volume"))


def drmeter(stream: DataFrame, by: str, block: int) -> DataFrame:
    """(by, dr): dynamic range in dB: the second greatest block peak over the mean of the loudest fifth of the blocks' RMS
    (times the root of two), blocks of ``block`` samples; the greatest peak where there is one block."""
    n = numbered(stream, by).withColumn("_k", F.floor(F.col("_n") / block))
    blocks = n.groupBy(by, "_k").agg(F.sqrt(2 * F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max(F.abs("v")).alias("peak"))
    loud = Window.partitionBy(by).orderBy(F.desc("rms"), "_k")
    high = Window.partitionBy(by).orderBy(F.desc("peak"), "_k")
    ranked = blocks.withColumns({"_r": F.row_number().over(loud), "_p": F.row_number().over(high), "_c": F.count("*").over(Window.partitionBy(by))})
    top = F.when(F.col("_r") <= F.ceil(F.col("_c") * 0.2), F.col("rms") * F.col("rms"))
    second = F.max(F.when(F.col("_p") == F.least(F.lit(2).cast("long"), F.col("_c")), F.col("peak")))
    return ranked.groupBy(by).agg((-20 * F.log10(F.sqrt(F.avg(top)) / second)).alias("dr"))


def loudnorm(stream: DataFrame, by: str, target: float = -24.0, peak: float = -2.0) -> DataFrame:
    """One gain for a whole stream brings its mean power to ``target`` dB; samples are cut at ``peak`` dB. Silence stays."""
    measured = stream.groupBy(by).agg(F.avg(F.col("v") * F.col("v")).alias("_z"))
    gain = F.when(F.col("_z") > 0, F.pow(F.lit(10.0), (target - 10 * F.log10("_z")) / 20)).otherwise(1.0)
    top = 10 ** (peak / 20)
    return stream.join(measured, by).withColumn("v", _held(F.col("v") * gain, -top, top)).drop("_z")


def silenceremove(stream: DataFrame, by: str, window: int, threshold: float, start: bool = True, stop: bool = True) -> DataFrame:
    """Drops the windows of samples before the first and after the last one that is louder than ``threshold``."""
    n = numbered(stream, by).withColumn("_k", F.floor(F.col("_n") / window))
    loud = n.groupBy(by, "_k").agg(F.max(F.abs("v")).alias("_m")).filter(F.col("_m") > threshold).groupBy(by).agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    out = n.join(loud, by)
    if start:
        out = out.filter("_k >= _first")
    if stop:
        out = out.filter("_k <= _last")
    return out.select(*stream.columns)


def apsyclip(x: Column, clip: float = 1.0, level_in: float = 1.0, level_out: float = 1.0) -> Column:
    return _held(x * level_in, -clip, clip) * level_out


# Sources: (n, t, v)


def _samples(spark: SparkSession, n: int, rate: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("n"), (F.col("id") / rate).alias("t"))


def sine(spark: SparkSession, n: int, frequency: float = 440.0, beep_factor: float = 0.0, rate: int = 44_100) -> DataFrame:
    """An eighth of full scale; a beep of ``beep_factor`` times the frequency sounds for the first 40 ms of each second."""
    wave = 0.125 * F.sin(2 * math.pi * frequency * F.col("n") / rate)
    if beep_factor:
        wave = wave + F.when(F.col("n") % rate < rate // 25, 0.25 * F.sin(2 * math.pi * frequency * beep_factor * F.col("n") / rate)).otherwise(0.0)
    return _samples(spark, n, rate).withColumn("v", wave)


def anoisesrc(spark: SparkSession, n: int, amplitude: float = 1.0, seed: int = 0, rate: int = 48_000) -> DataFrame:
    """White noise: each sample is drawn evenly, by a hash of its number and the seed, so that every run has the same."""
    return _samples(spark, n, rate).withColumn("v", amplitude * (2 * (F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) - 1))


def aevalsrc(spark: SparkSession, n: int, expression: str, rate: int = 44_100) -> DataFrame:
    """An expression of n, t and s (the rate)."""
    own = _samples(spark, n, rate)
    return own.withColumn("v", to_column(expression, {"n": F.col("n"), "t": F.col("t"), "s": F.lit(rate)}))


def _sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(math.pi * x) / F.when(F.abs(x) < 1e-12, 1.0).otherwise(math.pi * x))


def afdelaysrc(spark: SparkSession, delay: float, taps: int = 0) -> DataFrame:
    """(n, v): taps of a fractional delay, a sinc without a window; twice the delay's whole part and one, if not given."""
    n = taps or 2 * math.floor(delay) + 1
    return spark.range(n).select(F.col("id").alias("n"), _sinc(F.col("id") - delay).alias("v"))


def hilbert(spark: SparkSession, taps: int = 31) -> DataFrame:
    """(n, v): taps of a Hilbert transformer, by a Blackman window."""
    k = F.col("id") - taps // 2
    w = 0.42 - 0.5 * F.cos(2 * math.pi * F.col("id") / (taps - 1)) + 0.08 * F.cos(4 * math.pi * F.col("id") / (taps - 1))
    return spark.range(taps).select(F.col("id").alias("n"), (F.when(k % 2 == 0, 0.0).otherwise(2 / (math.pi * F.when(k % 2 == 0, F.lit(1)).otherwise(k))) * w).alias("v"))


def sinc(spark: SparkSession, cutoff: float, rate: int = 44_100, taps: int = 31, beta: float = 8.0) -> DataFrame:
    """(n, v): taps of a low-pass at ``cutoff``, by a Kaiser window."""
    bessel = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), lambda a, k: F.struct((a["s"] + a["t"] * F.pow(x / (2 * k), 2)).alias("s"), (a["t"] * F.pow(x / (2 * k), 2)).alias("t")), lambda a: a["s"])
    half = (taps - 1) / 2
    k = F.col("id") - half
    window = bessel(beta * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(k / half, 2)))) / bessel(F.lit(beta))
    f = 2 * cutoff / rate
    return spark.range(taps).select(F.col("id").alias("n"), (f * _sinc(f * k) * window).alias("v"))
