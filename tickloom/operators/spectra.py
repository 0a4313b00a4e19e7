"""Frequency domain: transforms of arrays, measures of spectra, block-transform denoisers and rate conversion, by numpy on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import payload
from .order import numbered


def dct(x: np.ndarray, kind: int = 2) -> np.ndarray:
    """Unscaled cosine transforms of the last axis: kind 2, or 3 (its inverse, but for a factor of n / 2)."""
    n = x.shape[-1]
    k, t = np.arange(n), np.arange(n)
    if kind == 2:
        return x @ np.cos(np.pi / n * np.outer(t + 0.5, k))
    return x[..., :1] / 2 + x[..., 1:] @ np.cos(np.pi / n * np.outer(k[1:], t + 0.5))


def dst(x: np.ndarray) -> np.ndarray:
    """The unscaled sine transform of kind 1."""
    n = x.shape[-1]
    k = np.arange(1, n + 1)
    return x @ np.sin(np.pi / (n + 1) * np.outer(k, k))


def mdct(x: np.ndarray) -> np.ndarray:
    """n values of 2 n samples; ``imdct`` of overlapping windows gives them back."""
    n = x.shape[-1] // 2
    t, k = np.arange(2 * n), np.arange(n)
    return x @ np.cos(np.pi / n * np.outer(t + 0.5 + n / 2, k + 0.5))


def imdct(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    t, k = np.arange(2 * n), np.arange(n)
    return x @ np.cos(np.pi / n * np.outer(k + 0.5, t + 0.5 + n / 2)) * 2 / n


#: Transforms of real samples: name to a function that gives real numbers.
TRANSFORMS = {
    "fft": lambda x: np.stack([(z := np.fft.fft(x)).real, z.imag], axis=-1).reshape(-1), "rdft": lambda x: np.stack([(z := np.fft.rfft(x)).real, z.imag], axis=-1).reshape(-1),
    "dct": dct, "idct": lambda x: dct(x, 3), "dst": dst, "mdct": mdct, "imdct": imdct,
}


def transformed(blocks: DataFrame, kind: str, column: str = "samples") -> DataFrame:
    """Adds ``spectrum`` of each array; an empty one stays empty."""
    return payload.each(blocks, lambda x: (TRANSFORMS[kind](np.array(x, float)).tolist() if x else [],), [column], "spectrum array<double>")


#: What ``spectral_statistics`` adds.
MEASURES = ("mean", "variance", "centroid", "spread", "skewness", "kurtosis", "entropy", "flatness", "crest", "slope", "decrease", "rolloff")


def spectral_measures(x: np.ndarray, rate: float) -> list[float]:
    """Of one block's magnitudes, by a Hann window; NaN where silence leaves them open."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
    m = np.abs(np.fft.rfft(x * window)) / max(1, len(x))
    f = np.arange(len(m)) * rate / len(x)
    total = m.sum()
    nan = float("nan")
    if total == 0:
        return [0.0, 0.0] + [nan] * 10
    p = m / total
    centroid = float((f * p).sum())
    spread = math.sqrt(float((((f - centroid) ** 2) * p).sum()))
    power = lambda k: float((((f - centroid) / spread) ** k * p).sum()) if spread else nan
    entropy = float(-(p[p > 0] * np.log(p[p > 0])).sum() / math.log(len(m)))
    flatness = float(np.exp(np.log(m[m > 0]).mean()) / m.mean()) if (m > 0).all() else 0.0
    centred = f - f.mean()
    slope = float((centred * (m - m.mean())).sum() / (centred**2).sum())
    decrease = float(((m[1:] - m[0]) / np.arange(1, len(m))).sum() / m[1:].sum()) if m[1:].sum() else nan
    rolloff = float(f[np.searchsorted(np.cumsum(m), 0.85 * total)])
    return [float(m.mean()), float(m.var()), centroid, spread, power(3), power(4), entropy, flatness, float(m.max() / m.mean()), slope, decrease, rolloff]


def spectral_statistics(blocks: DataFrame, rate: float, column: str = "samples") -> DataFrame:
    """Adds the measures of each block of samples."""
    return payload.each(blocks, lambda x: tuple(spectral_measures(np.array(x, float), rate)) if x else (None,) * len(MEASURES), [column], ", ".join(f"{m} double" for m in MEASURES))


def aspectralstats(stream: DataFrame, by: str, rate: float, win_size: int = 2048, overlap: float = 0.5) -> DataFrame:
    """(by, block, measures, flux): of windows of ``win_size`` samples, a hop apart; flux is the distance of magnitudes to the window before,
    0 for the first. Incomplete windows don't count. Each sample goes to the few windows that hold it."""
    hop = max(1, round(win_size * (1 - overlap)))
    n = numbered(stream, by)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_n") - win_size + 1) / hop))
    spread = n.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("_n") / hop))))
    held = spread.groupBy(by, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("v").alias("v")))), lambda x: x["v"]).alias("samples")).filter(F.size("samples") == win_size)
    before = held.select(by, (F.col("block") + 1).alias("block"), F.col("samples").alias("before"))

    def flux(now: list, old: list | None) -> tuple:
        if old is None:
            return (0.0,)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(now)) / len(now))
        a, b = (np.abs(np.fft.rfft(np.array(x, float) * window)) / len(now) for x in (now, old))
        return (float(np.sqrt(((a - b) ** 2).sum())),)

    both = payload.each(held.join(before, [by, "block"], "left"), flux, ["samples", "before"], "flux double").select(by, "block", "flux")
    return spectral_statistics(held, rate).drop("samples").join(both, [by, "block"])


def sinc_taps(source: int, target: int, half: int = 16) -> tuple[int, int, np.ndarray]:
    """(up, down, taps of each phase): a low-pass by a Kaiser window for a conversion by up / down in lowest terms."""
    g = math.gcd(source, target)
    up, down = target // g, source // g
    cutoff = min(1.0, up / down)
    n = 2 * half
    t = np.arange(n)[None] - half + 1 - np.arange(up)[:, None] / up
    taps = cutoff * np.sinc(cutoff * t) * np.i0(8.0 * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(8.0)
    return up, down, taps / taps.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase rate conversion; beyond both ends there is silence."""
    if source == target or not len(x):
        return np.asarray(x, float)
    up, down, taps = sinc_taps(source, target)
    half = taps.shape[1] // 2
    out = -(-len(x) * up // down)
    place = np.arange(out) * down
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    return np.einsum("ij,ij->i", windows[place // up], taps[place % up])


def aresample(blocks: DataFrame, source: int, target: int, column: str = "samples") -> DataFrame:
    """Each array at another rate."""
    return payload.each(blocks, lambda x: (resample(np.array(x, float), source, target).tolist(),), [column], f"{column} array<double>")


# Pictures


def _blocks(p: np.ndarray, n: int) -> np.ndarray:
    h, w = p.shape
    return np.pad(p, ((0, -h % n), (0, -w % n)), mode="edge")


def dctdnoiz(p: np.ndarray, sigma: float, n: int = 8) -> np.ndarray:
    """Coefficients of blocks below three sigma become 0, but for the mean."""
    h, w = p.shape
    x = _blocks(p.astype(float), n)
    basis = np.cos(np.pi / n * np.outer(np.arange(n), np.arange(n) + 0.5)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    tiles = x.reshape(x.shape[0] // n, n, x.shape[1] // n, n).transpose(0, 2, 1, 3)
    c = basis @ tiles @ basis.T
    keep = np.abs(c) >= 3 * sigma
    keep[..., 0, 0] = True
    back = basis.T @ (c * keep) @ basis
    return np.clip(np.rint(back.transpose(0, 2, 1, 3).reshape(x.shape)[:h, :w]), 0, 255).astype(np.uint8)


def fftdnoiz(p: np.ndarray, sigma: float, amount: float = 1.0, n: int = 8) -> np.ndarray:
    """Powers of blocks lose the noise's, down to a part of 1 - amount."""
    h, w = p.shape
    x = _blocks(p.astype(float), n)
    tiles = x.reshape(x.shape[0] // n, n, x.shape[1] // n, n).transpose(0, 2, 1, 3)
    z = np.fft.fft2(tiles)
    power = np.abs(z) ** 2
    gain = np.maximum(1 - amount, 1 - (sigma * n) ** 2 / np.maximum(power, 1e-12))
    gain[..., 0, 0] = 1
    return np.clip(np.rint(np.fft.ifft2(z * gain).real.transpose(0, 2, 1, 3).reshape(x.shape)[:h, :w]), 0, 255).astype(np.uint8)


def owdenoise(p: np.ndarray, strength: float, levels: int = 3) -> np.ndarray:
    """Details of an à-trous wavelet are shrunk by ``strength``, halved at each level."""
    now, details = p.astype(float), []
    for k in range(levels):
        step = 1 << k
        smooth = now
        for axis in (0, 1):
            pad = [(2 * step, 2 * step) if a == axis else (0, 0) for a in (0, 1)]
            q = np.pad(smooth, pad, mode="edge")
            size = smooth.shape[axis]
            smooth = sum(c * np.take(q, np.arange(size) + 2 * step + d * step, axis=axis) for d, c in zip((-2, -1, 0, 1, 2), (1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16), strict=True))
        details.append(now - smooth)
        now = smooth
    for k, d in enumerate(details):
        t = strength / 2**k
        now = now + np.sign(d) * np.maximum(np.abs(d) - t, 0)
    return np.clip(np.rint(now), 0, 255).astype(np.uint8)


def nlmeans(p: np.ndarray, strength: float = 1.0, patch: int = 3, reach: int = 5) -> np.ndarray:
    """Means over a search window, weighed by how alike the patches around are."""
    x = p.astype(float)
    r, s = patch // 2, reach // 2
    big = np.pad(x, s + r, mode="edge")
    h, w = x.shape
    total, weight = np.zeros_like(x), np.zeros_like(x)
    here = big[s : s + h + 2 * r, s : s + w + 2 * r]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            there = big[s + dy : s + dy + h + 2 * r, s + dx : s + dx + w + 2 * r]
            d = np.lib.stride_tricks.sliding_window_view((here - there) ** 2, (patch, patch)).mean(axis=(2, 3))
            g = np.exp(-d / (100 * strength * strength))
            total += g * there[r : r + h, r : r + w]
            weight += g
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """The mean of the structural similarity over Gaussian windows of eleven pixels, or as many as there are."""
    n = min(11, *a.shape)
    t = np.arange(n) - (n - 1) / 2
    g = np.exp(-t * t / (2 * 1.5**2))
    g /= g.sum()
    mean = lambda x: np.einsum("ijkl,k,l->ij", np.lib.stride_tricks.sliding_window_view(x, (n, n)), g, g)
    a, b = a.astype(float), b.astype(float)
    ma, mb = mean(a), mean(b)
    va, vb, cab = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


#: Filters of one plane.
PLANES = {"dctdnoiz": dctdnoiz, "fftdnoiz": fftdnoiz, "owdenoise": owdenoise, "vaguedenoiser": owdenoise, "nlmeans": nlmeans}


def on_plane(frames: DataFrame, name: str, *options: float, plane: str = "p0") -> DataFrame:
    """A filter of ``PLANES`` on one plane of each frame; see ``pixels`` for frames."""

    def one(p: list, w: int, h: int) -> tuple:
        return (PLANES[name](np.array(p, np.uint8).reshape(h, w), *options).reshape(-1).tolist() if w * h else [],)

    done = payload.each(frames.withColumnRenamed(plane, "_plane"), one, ["_plane", "w", "h"], "_new array<int>")
    return done.drop("_plane").withColumnRenamed("_new", plane).select(*frames.columns)


def ssim_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``ssim`` of two planes of each row (``w``, ``h``)."""
    return payload.each(pairs, lambda x, y, w, h: (ssim(np.array(x, float).reshape(h, w), np.array(y, float).reshape(h, w)),), [a, b, "w", "h"], "ssim double")


def siti(frames: DataFrame, by: str) -> DataFrame:
    """(.., si, ti): the deviation of the gradient's length inside a frame, and of its difference to the frame before (0 for the first).
    Frames of a stream are in order of ``n``."""
    from pyspark.sql import Window

    before = F.lag("p0").over(Window.partitionBy(by).orderBy("n"))

    def one(p: list, w: int, h: int, old: list | None) -> tuple:
        x = np.array(p, float).reshape(h, w)
        v = np.lib.stride_tricks.sliding_window_view(x, (3, 3))
        gx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
        size = np.hypot((v * gx).sum(axis=(2, 3)), (v * gx.T).sum(axis=(2, 3)))
        return float(size.std()), 0.0 if old is None else float((x - np.array(old, float).reshape(h, w)).std())

    return payload.each(frames.withColumn("_old", before), one, ["p0", "w", "h", "_old"], "si double, ti double").drop("_old")
