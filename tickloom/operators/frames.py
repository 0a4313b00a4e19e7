"""Filters over successive frames: the pixel at one place in several frames of a stream. Frames of a stream (``by``) are numbered by ``n``, and have
w, h and planes as in ``pixels``. A window of frames is held in a row; nothing else is gathered."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import elementwise

PLANES = ("p0", "p1", "p2", "p3")


def _planes(frames: DataFrame) -> list[str]:
    return [c for c in PLANES if c in frames.columns]


def _replaced(frames: DataFrame, new: dict[str, Column]) -> DataFrame:
    made = frames.withColumns({f"_new{c}": x for c, x in new.items()})
    return made.select(*[F.col(f"_new{c}").alias(c) if c in new else F.col(c) for c in frames.columns])


def over_time(frames: DataFrame, by: str, before: int, after: int, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Each pixel anew: ``value`` of its values in the frames from ``before`` earlier to ``after`` later (an array, in order; fewer at the ends), and its own."""
    w = Window.partitionBy(by).orderBy("n").rowsBetween(-before, after)
    own = _planes(frames)
    held = frames.withColumns({f"_h{c}": F.collect_list(c).over(w) for c in own})
    make = lambda c: F.transform(held[c], lambda v, i: value(F.transform(held[f"_h{c}"], lambda p: F.get(p, i)), v).cast("int"))
    return _replaced(held, {c: make(c) for c in own}).select(*frames.columns)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def tmix(frames: DataFrame, by: str, count: int = 3, weights: list[float] | None = None) -> DataFrame:
    """The weighted mean of the last ``count`` frames, rounded; weights from the oldest one on."""
    w = [*(weights or [1.0]), *[(weights or [1.0])[-1]] * count][:count]
    factors = F.array(*map(F.lit, map(float, w)))
    return over_time(frames, by, count - 1, 0, lambda xs, v: F.floor(_total(F.transform(xs, lambda x, k: x * F.get(factors, k))) / _total(F.slice(factors, 1, F.size(xs))) + 0.5))


def tmedian(frames: DataFrame, by: str, radius: int = 1, percentile: float = 0.5, compat: bool = True) -> DataFrame:
    """The value of a rank among 2 radius + 1 frames: the last ones (``compat``), or those around."""
    before, after = (2 * radius, 0) if compat else (radius, radius)
    return over_time(frames, by, before, after, lambda xs, v: F.get(F.array_sort(xs), F.floor(percentile * (F.size(xs) - 1) + 0.5).cast("int")))


def atadenoise(frames: DataFrame, by: str, size: int = 9, a: float = 0.02, b: float = 0.04, compat: bool = True) -> DataFrame:
    """The mean of the last ``size`` frames (or those around), each the less the more it differs: fully up to ``a`` of 255, not at all from ``b`` on."""
    before, after = (size - 1, 0) if compat else (size // 2, size // 2)
    low, high = a * 255, b * 255
    weight = lambda d: F.when(d <= low, 1.0).when(d >= high, 0.0).otherwise((high - d) / (high - low) if high > low else 0.0)
    return over_time(frames, by, before, after, lambda xs, v: F.floor(_total(F.transform(xs, lambda x: x * weight(F.abs(x - v)))) / _total(F.transform(xs, lambda x: weight(F.abs(x - v)))) + 0.5))


def amplify(frames: DataFrame, by: str, radius: int = 2, factor: float = 2.0, threshold: float = 10.0, tolerance: float = 0.0) -> DataFrame:
    def value(xs: Column, v: Column) -> Column:
        d = v - _total(xs) / F.size(xs)
        grown = F.floor(v + d * factor + 0.5)
        return F.when((F.abs(d) < threshold) & (F.abs(d) > tolerance), F.greatest(F.lit(0), F.least(F.lit(255), grown))).otherwise(v)

    return over_time(frames, by, radius, radius, value)


def lagfun(frames: DataFrame, by: str, decay: float = 0.95, reach: int | None = None) -> DataFrame:
    """The greater of the pixel and the last result times ``decay``, rounded at the end. A pixel of 255 has faded below a half, and counts no more, after
    as many frames as the window holds; ``reach`` may hold fewer."""
    frames_held = reach or max(1, math.ceil(math.log(0.5 / 255) / math.log(decay)))
    return over_time(frames, by, frames_held, 0, lambda xs, v: F.floor(F.array_max(F.transform(xs, lambda x, k: x * F.pow(F.lit(decay), (F.size(xs) - 1 - k).cast("double")))) + 0.5))


def tblend(frames: DataFrame, by: str, mode: str = "average", opacity: float = 1.0) -> DataFrame:
    """Each frame but the first with the one before, by a mode of ``elementwise.BLEND``."""
    w = Window.partitionBy(by).orderBy("n")
    own = _planes(frames)
    held = frames.withColumns({f"_b{c}": F.lag(c).over(w) for c in own}).filter(f"_b{own[0]} is not null")
    mixed = lambda v, o: F.floor(v * (1 - opacity) + elementwise.blend(mode, v.cast("long"), o.cast("long")) * opacity + 0.5)
    make = lambda c: F.transform(held[c], lambda v, i: mixed(v, F.get(held[f"_b{c}"], i)).cast("int"))
    return _replaced(held, {c: make(c) for c in own}).select(*frames.columns)


def difference(frames: DataFrame, by: str, plane: str = "p0") -> DataFrame:
    """Adds ``motion``: the mean absolute difference to the frame before, 0 for the first."""
    w = Window.partitionBy(by).orderBy("n")
    held = frames.withColumn("_b", F.lag(plane).over(w))
    total = F.aggregate(F.zip_with(held[plane], held["_b"], lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, v: a + v)
    return held.withColumn("motion", F.coalesce(total / F.size(held[plane]), F.lit(0.0))).drop("_b")


def mpdecimate(frames: DataFrame, by: str, high: int = 768, low: int = 320, frac: float = 0.33, block: int = 8) -> DataFrame:
    """Drops frames like the one before: no block's sum of absolute differences over ``high``, and less than ``frac`` of the blocks over ``low``."""
    w = Window.partitionBy(by).orderBy("n")
    held = frames.withColumn("_b", F.lag("p0").over(w))
    across = F.ceil(held["w"] / block)
    blocks = (across * F.ceil(held["h"] / block)).cast("int")
    which = lambda i: F.floor(F.floor(i / held["w"]) / block) * across + F.floor((i % held["w"]) / block)
    diffs = F.transform(held["p0"], lambda v, i: F.struct(which(i).cast("int").alias("k"), F.abs(v - F.get(held["_b"], i)).alias("d")))
    sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.aggregate(F.filter(F.col("_d"), lambda x: x["k"] == k), F.lit(0), lambda a, x: a + x["d"]))
    counted = held.withColumn("_d", diffs).withColumn("_s", sums)
    goes = F.forall("_s", lambda s: s <= high) & (F.size(F.filter("_s", lambda s: s > low)) / F.size("_s") < frac)
    return counted.filter(F.col("_b").isNull() | ~goes).select(*frames.columns)


def cropdetect(frames: DataFrame, by: str, limit: int = 24, round: int = 16, skip: int = 2) -> DataFrame:
    """(by, n, x1, x2, y1, y2, w, h, x, y): the box around everything above ``limit`` in all frames so far but the first ``skip``; w and h are multiples of
    ``round``, in the middle of it. Nulls for skipped frames, and where nothing was bright yet."""
    f = frames.filter(F.col("n") >= skip)
    places = F.filter(F.transform(f["p0"], lambda v, i: F.when(v > limit, i)), lambda i: i.isNotNull())
    box = f.withColumn("_i", places).withColumns({
        "_x1": F.array_min(F.transform("_i", lambda i: i % F.col("w"))), "_x2": F.array_max(F.transform("_i", lambda i: i % F.col("w"))),
        "_y1": F.floor(F.array_min("_i") / F.col("w")), "_y2": F.floor(F.array_max("_i") / F.col("w")),
    })
    w = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = box.select(by, "n", F.min("_x1").over(w).alias("x1"), F.max("_x2").over(w).alias("x2"), F.min("_y1").over(w).alias("y1"), F.max("_y2").over(w).alias("y2"))
    size = lambda a, b: F.floor((b - a + 1) / round) * round
    out = out.withColumns({"w": size(F.col("x1"), F.col("x2")), "h": size(F.col("y1"), F.col("y2"))})
    out = out.withColumns({"x": F.col("x1") + F.floor((F.col("x2") - F.col("x1") + 1 - F.col("w")) / 2), "y": F.col("y1") + F.floor((F.col("y2") - F.col("y1") + 1 - F.col("h")) / 2)})
    return frames.select(by, "n").join(out, [by, "n"], "left")


def black_share(frames: DataFrame, pixel_black: float = 0.10) -> Column:
    """The share of the pixels of plane 0 that are at most ``pixel_black`` of 255."""
    return F.size(F.filter(frames["p0"], lambda v: v <= pixel_black * 255)) / F.size(frames["p0"])


def blackframe(frames: DataFrame, by: str, amount: int = 98, threshold: int = 32) -> DataFrame:
    """(by, n, pblack): frames with at least ``amount`` per cent of pixels below ``threshold``, cut to whole per cents."""
    share = F.floor(100 * F.size(F.filter(frames["p0"], lambda v: v < threshold)) / F.size(frames["p0"]))
    return frames.select(by, "n", share.cast("int").alias("pblack")).filter(F.col("pblack") >= amount)


def blackdetect(frames: DataFrame, by: str, picture_black_ratio: float = 0.98, pixel_black: float = 0.10) -> DataFrame:
    """(by, n, black_start, black_end): on the first frame of a black run its number, and on the first one after it that one's; other frames have no row."""
    w = Window.partitionBy(by).orderBy("n")
    dark = frames.select(by, "n", (black_share(frames, pixel_black) >= picture_black_ratio).alias("_d"))
    both = dark.withColumn("_p", F.coalesce(F.lag("_d").over(w), F.lit(False)))
    return both.filter("_d <> _p").select(by, "n", F.when(F.col("_d"), F.col("n")).alias("black_start"), F.when(~F.col("_d"), F.col("n")).alias("black_end"))


def freezeframes(frames: DataFrame, by: str, other: DataFrame, first: int, last: int, replace: int = 0) -> DataFrame:
    """Frames ``first`` to ``last`` become the frame ``replace`` of another stream."""
    one = other.filter(F.col("n") == replace).select(by, *[F.col(c).alias(f"_o{c}") for c in _planes(frames)])
    both = frames.join(one, by, "left")
    inside = F.col("n").between(first, last)
    return _replaced(both, {c: F.when(inside & F.col(f"_o{c}").isNotNull(), F.col(f"_o{c}")).otherwise(both[c]) for c in _planes(frames)}).select(*frames.columns)


def tile(frames: DataFrame, by: str, columns: int, rows: int, margin: int = 0, padding: int = 0, color: int = 0) -> DataFrame:
    """(by, n, w, h, planes): each columns times rows frames become a grid, row by row; cells that are missing at the end, margins and paddings have ``color``.
    All frames of a stream have one size."""
    size = columns * rows
    own = _planes(frames)
    cells = frames.withColumn("_g", F.floor(F.col("n") / size)).groupBy(by, "_g").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("n") % size).cast("int").alias("k"), F.struct(*own).alias("p")))).alias("_m"), F.max("w").alias("_w"), F.max("h").alias("_h")
    )
    w, h = cells["_w"], cells["_h"]
    wide, high = 2 * margin + columns * w + padding * (columns - 1), 2 * margin + rows * h + padding * (rows - 1)

    def pixel(c: str) -> Column:
        def value(i: Column) -> Column:
            x, y = i % wide - margin, F.floor(i / wide).cast("int") - margin
            col, row = F.floor(x / (w + padding)).cast("int"), F.floor(y / (h + padding)).cast("int")
            a, b = x - col * (w + padding), y - row * (h + padding)
            inside = (x >= 0) & (y >= 0) & (col < columns) & (row < rows) & (a < w) & (b < h)
            return F.coalesce(F.when(inside, F.get(F.try_element_at(cells["_m"], row * columns + col)[c], b * w + a)), F.lit(color))

        return F.transform(F.sequence(F.lit(0), wide * high - 1), lambda i: value(i))

    return cells.select(by, F.col("_g").alias("n"), wide.alias("w"), high.alias("h"), *[pixel(c).alias(c) for c in own])


def shuffled(frames: DataFrame, by: str, size: int = 30, seed: int = 0) -> DataFrame:
    """Frames in another order within each ``size`` of them, by hashes of their numbers and the seed; ``n`` is the new number."""
    g = F.floor(F.col("n") / size)
    place = F.row_number().over(Window.partitionBy(by, "_g").orderBy(F.xxhash64("n", F.lit(seed)), "n")) - 1
    return frames.withColumn("_g", g).withColumn("_n", F.col("_g") * size + place).drop("n", "_g").withColumnRenamed("_n", "n").select(*frames.columns)


def palettegen(frames: DataFrame, size: int = 256) -> list[tuple[int, int, int]]:
    """Colours of all frames by median cut; see ``stats.median_cut``."""
    from .stats import median_cut

    pixel = frames.select(F.explode(F.arrays_zip("p0", "p1", "p2")).alias("z")).select("z.p0", "z.p1", "z.p2")
    return [tuple(int(x + 0.5) for x in c) for c in median_cut(pixel, ["p0", "p1", "p2"], size)]
