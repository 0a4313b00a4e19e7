"""Statistics of streams and of pairs of streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, ordered, previous, tie


def decibels(x: Column) -> Column:
    """20 log10 of an amplitude; minus infinity at 0."""
    return F.when(x > 0, 20 * F.log10(x)).otherwise(F.lit(float("-inf")))


def astats(stream: DataFrame, by: str) -> DataFrame:
    """Level statistics of each stream: mean, least, greatest, peak and RMS level in dB, crest factor (null for silence), records."""
    rms, peak = F.sqrt(F.avg(F.col("v") * F.col("v"))), F.max(F.abs("v"))
    return stream.groupBy(by).agg(
        F.avg("v").alias("dc_offset"), F.min("v").alias("min_level"), F.max("v").alias("max_level"), decibels(peak).alias("peak_db"), decibels(rms).alias("rms_db"),
        F.try_divide(peak, rms).alias("crest"), F.count("v").alias("samples"),
    )


def zero_crossings(stream: DataFrame, by: str, level: float = 0.0, bucket: int | None = None) -> DataFrame:
    """(by, crossings, rate): how often a stream passes ``level``, and that as a share of its records."""
    above = stream.withColumn("_a", F.col("v") >= level)
    crossed = previous(above, by, {"_p": F.col("_a")}, bucket).withColumn("_c", (F.col("_a") != F.col("_p")).cast("int"))
    return crossed.groupBy(by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("crossings"), (F.coalesce(F.sum("_c"), F.lit(0)) / F.count("*")).alias("rate"))


def astats_rollup(stream: DataFrame, *by: str) -> DataFrame:
    """Level statistics for all of ``by``, for fewer and fewer of them from the right, and over all (nulls, ``level`` says how many
    are left out)."""
    return stream.rollup(*by).agg(F.grouping_id().alias("level"), F.avg("v").alias("dc_offset"), F.min("v").alias("min_level"), F.max("v").alias("max_level"), F.count("v").alias("samples"))


def histogram(stream: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values in [low, high)."""
    k = F.floor((F.col("v") - low) / ((high - low) / bins))
    return stream.filter((F.col("v") >= low) & (F.col("v") < high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def entropy(stream: DataFrame, low: float, high: float, bins: int, by: str, mode: str = "normal") -> DataFrame:
    """(by, entropy, normalized_entropy): bits of each stream's histogram, and that over the greatest possible, log2 of ``bins``.

    diff: of the absolute differences of neighbouring bins, empty ones included, over the number of records. Counts are
    combined before they are shuffled."""
    k = F.floor((F.col("v") - low) / ((high - low) / bins))
    counts = stream.filter((F.col("v") >= low) & (F.col("v") < high)).groupBy(by, k.alias("_k")).agg(F.count("*").alias("_n"))
    if mode == "normal":
        n = F.sum("_n")
        found = counts.groupBy(by).agg((F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("entropy"))
    else:
        held = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_n"))).alias("_h"), F.sum("_n").alias("_t"))
        at = lambda i: F.coalesce(F.try_element_at("_h", i.cast("long")), F.lit(0))
        share = lambda i: F.abs(at(i) - at(i - 1)) / F.col("_t")
        bits = F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)), F.lit(0.0), lambda a, i: a + F.when(share(i) > 0, -share(i) * F.log2(F.when(share(i) > 0, share(i)))).otherwise(0.0))
        found = held.select(by, bits.alias("entropy"))
    return found.withColumn("normalized_entropy", F.col("entropy") / math.log2(bins))


def asisdr(pairs: DataFrame, by: str) -> DataFrame:
    """(by, si_sdr): the signal-to-distortion ratio in dB of a, the estimate, to b, the reference, scaled to fit best."""
    aa, bb, ab = F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b")), F.sum(F.col("a") * F.col("b"))
    signal = ab * ab / bb
    return pairs.groupBy(by).agg(F.when(bb > 0, F.when(aa - signal > 0, 10 * F.log10(signal / (aa - signal))).otherwise(F.lit(float("inf")))).alias("si_sdr"))


def waveform(frames: DataFrame, key: str, bins: int = 256) -> DataFrame:
    """(key, x, bin, n): how often each value occurs in each column of a frame (``w`` and ``p0`` as in ``pixels``)."""
    pixel = frames.select(key, "w", F.posexplode("p0").alias("i", "v"))
    return pixel.groupBy(key, (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("v") * bins / 256).alias("bin")).agg(F.count("*").alias("n"))


def vectorscope(frames: DataFrame, key: str) -> DataFrame:
    """(key, u, v, n): how often pairs of values of planes 1 and 2 occur in a frame."""
    pixel = frames.select(key, F.explode(F.arrays_zip("p1", "p2")).alias("z")).select(key, F.col("z.p1").alias("u"), F.col("z.p2").alias("v"))
    return pixel.groupBy(key, "u", "v").agg(F.count("*").alias("n"))


def plane_statistics(frames: DataFrame, key: str, black: int = 32, least: int = 16) -> DataFrame:
    """(key, mean, stdev, lowest, highest, black, x1, x2, y1, y2): of plane 0 of each frame. black: the share of pixels below ``black`` in per cent;
    x1 .. y2: the box around pixels above ``least``, null if there are none."""
    above = lambda c: F.when(F.col("v") > least, c)
    pixel = frames.select(key, "w", F.posexplode("p0").alias("i", "v")).withColumns({"_x": F.col("i") % F.col("w"), "_y": F.floor(F.col("i") / F.col("w"))})
    return pixel.groupBy(key).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"), F.min("v").alias("lowest"), F.max("v").alias("highest"), (100 * F.avg((F.col("v") < black).cast("int"))).alias("black"),
        F.min(above(F.col("_x"))).alias("x1"), F.max(above(F.col("_x"))).alias("x2"), F.min(above(F.col("_y"))).alias("y1"), F.max(above(F.col("_y"))).alias("y2"),
    )


def error_measures(pairs: DataFrame, by: str, peak: float) -> DataFrame:
    """Of pairs (a, b): mean squared and absolute error, PSNR in dB (infinite if equal), signal-to-distortion ratio, share
    of equal records."""
    d = F.col("a") - F.col("b")
    mse = F.avg(d * d)
    signal = F.sum(F.col("a") * F.col("a"))
    return pairs.groupBy(by).agg(
        mse.alias("mse"), F.avg(F.abs(d)).alias("msad"), F.when(mse > 0, 10 * F.log10(peak * peak / mse)).otherwise(F.lit(float("inf"))).alias("psnr"),
        F.when(F.sum(d * d) > 0, 10 * F.log10(signal / F.sum(d * d))).otherwise(F.lit(float("inf"))).alias("sdr"), F.avg(F.when(d == 0, 1.0).otherwise(0.0)).alias("identity"),
    )


def palette(values: DataFrame, column: str, size: int) -> DataFrame:
    """The ``size`` most frequent values, ties by value."""
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(size)


def loudness(stream: DataFrame, by: str, hop: int, ranged: bool = False, bucket: int | None = None) -> DataFrame:
    """(by, integrated, blocks): gated loudness of samples that are weighted already, blocks of four times ``hop`` samples, a hop apart.

    A block's loudness is -0.691 + 10 log10 of its mean power. Blocks of -70 or less go, then those of 10 or more below the loudness of
    what is left, on average. ranged: adds ``range``, from the 10th to the 95th percentile of blocks of thirty hops,
    of which those of -70 or less, and of 20 or more below their average, don't count. Incomplete hops don't count."""
    of = lambda z: -0.691 + 10 * F.log10(z)
    n = numbered(stream, by, bucket=bucket).withColumn("_k", F.floor(F.col("_n") / hop))
    hops = n.groupBy(by, "_k").agg(F.sum(F.col("v") * F.col("v")).alias("_s"), F.count("*").alias("_c")).filter(F.col("_c") == hop)

    def gated(length: int, relative: float) -> DataFrame:
        w = Window.partitionBy(by).orderBy("_k").rowsBetween(1 - length, 0)
        blocks = hops.withColumns({"_z": F.sum("_s").over(w) / (length * hop), "_full": F.count("*").over(w)}).filter((F.col("_full") == length) & (F.col("_z") > 0))
        loud = blocks.filter(of(F.col("_z")) > -70)
        return loud.withColumn("_m", F.avg("_z").over(Window.partitionBy(by))).filter(of(F.col("_z")) > of(F.col("_m")) - relative)

    out = gated(4, 10).groupBy(by).agg(of(F.avg("_z")).alias("integrated"), F.count("*").alias("blocks"))
    if ranged:
        p = F.percentile(of(F.col("_z")), F.array(F.lit(0.1), F.lit(0.95)))
        out = out.join(gated(30, 20).groupBy(by).agg((p[1] - p[0]).alias("range")), by, "left")
    return out


def ebur128(stream: DataFrame, by: str, rate: int, ranged: bool = True) -> DataFrame:
    """Integrated loudness in LUFS, and its range, of samples of one channel: weighted in order, then gated."""
    from .recursive import biquads, k_weighting

    return loudness(biquads(stream, by, k_weighting(rate)), by, round(rate * 0.1), ranged)


def replaygain(stream: DataFrame, by: str, rate: int) -> DataFrame:
    """(by, track_gain, track_peak): what brings a stream to -18 LUFS, and its greatest magnitude."""
    peaks = stream.groupBy(by).agg(F.max(F.abs("v")).alias("track_peak"))
    return peaks.join(ebur128(stream, by, rate, False).select(by, (-18 - F.col("integrated")).alias("track_gain")), by, "left")


def median_cut(values: DataFrame, columns: list[str], size: int) -> list[tuple[float, ...]]:
    """The means of at most ``size`` boxes of colours, by splitting the box with the widest range at its median, over and over.

    Colours are counted first; only distinct ones, of which 8-bit components allow a bounded number, are cut on the driver."""
    counts = values.groupBy(*columns).agg(F.count("*").alias("n")).toPandas().sort_values(columns)
    if counts.empty:
        return []
    colours, weights = counts[columns].to_numpy(float), counts["n"].to_numpy()
    boxes = [np.arange(len(colours))]
    while len(boxes) < size:
        spans = [np.ptp(colours[b], axis=0).max() if len(b) > 1 else 0.0 for b in boxes]
        at = int(np.argmax(spans))
        if spans[at] == 0:
            break
        box = boxes.pop(at)
        axis = int(np.ptp(colours[box], axis=0).argmax())
        box = box[np.argsort(colours[box, axis], kind="stable")]
        half = np.searchsorted(np.cumsum(weights[box]), weights[box].sum() / 2) + 1
        half = min(max(1, int(half)), len(box) - 1)
        boxes += [box[:half], box[half:]]
    return sorted(tuple(np.average(colours[b], axis=0, weights=weights[b])) for b in boxes)
