"""Sources of pictures: a row for each frame, its planes made by expressions of x, y and the frame's number. No input, no Python worker."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pixels import byte, draw


def pictures(spark: SparkSession, n: int, w: int, h: int, planes: list[Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """(n, w, h, p0 ..): each plane is a function of x, y and n."""
    own = spark.range(n).withColumnRenamed("id", "n")
    plane = lambda f: draw(F.lit(w), F.lit(h), lambda x, y: f(x, y, F.col("n")))
    return own.select("n", F.lit(w).alias("w"), F.lit(h).alias("h"), *[plane(f).alias(f"p{k}") for k, f in enumerate(planes)])


def color(spark: SparkSession, n: int, w: int, h: int, value: tuple[int, ...] = (0, 0, 0)) -> DataFrame:
    return pictures(spark, n, w, h, [lambda x, y, k, v=v: F.lit(v) for v in value])


def nullsrc(spark: SparkSession, n: int, tick: int = 40_000) -> DataFrame:
    """(n, pts): frames without pixels."""
    return spark.range(n).select(F.col("id").alias("n"), (F.col("id") * tick).alias("pts"))


def rgbtestsrc(spark: SparkSession, n: int, w: int, h: int, complement: bool = False) -> DataFrame:
    """Stripes of red, green and blue from top to bottom, each from dark to light; with complements, cyan, magenta and yellow below them."""
    stripes = 6 if complement else 3
    which = lambda y: F.floor(y * stripes / h)
    ramp = lambda x: F.floor(x * 256 / w)
    return pictures(spark, n, w, h, [lambda x, y, k, c=c: F.when((which(y) == c) | (which(y) >= 3) & (which(y) != c + 3), ramp(x)).otherwise(0) for c in range(3)])


def yuvtestsrc(spark: SparkSession, n: int, w: int, h: int) -> DataFrame:
    """Stripes in which luma, then either chroma, goes from dark to light; the others stay in the middle."""
    return pictures(spark, n, w, h, [lambda x, y, k, c=c: F.when(F.floor(y * 3 / h) == c, F.floor(x * 256 / w)).otherwise(128) for c in range(3)])


def allrgb(spark: SparkSession, side: int = 4096) -> DataFrame:
    """One picture in which each colour occurs as often as any other: with a side of 4096 once. Rows are its lines, so that no row is large."""
    bits = 2 * int(math.log2(side)) // 3  # of each component
    i = lambda x: F.col("y") * side + x
    top = (1 << bits) - 1
    lines = spark.range(side).select(F.col("id").alias("y"))
    part = lambda x, k: F.floor(F.floor(i(x) / (1 << bits * k)) % (1 << bits) * 255 / top).cast("int")
    return lines.select("y", *[_line(side, lambda x, k=k: part(x, k)).alias(f"p{k}") for k in range(3)])


def _line(w: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: f(x))


def allyuv(spark: SparkSession, side: int = 4096) -> DataFrame:
    return allrgb(spark, side)


#: Colours of bars from left to right, in the order white, yellow, cyan, green, magenta, red, blue, black.
BARS = ((1, 1, 1), (1, 1, 0), (0, 1, 1), (0, 1, 0), (1, 0, 1), (1, 0, 0), (0, 0, 1), (0, 0, 0))


def bars(spark: SparkSession, n: int, w: int, h: int, level: float = 0.75, count: int = 7) -> DataFrame:
    """RGB bars; ``level`` 0.75 or 1, ``count`` 7 (without black) or 8. White is 255 at a count of 8."""
    value = lambda k, c: (255 if count == 8 and k == 0 else round(255 * level)) * BARS[k][c]
    pick = lambda x, c: F.get(F.array(*[F.lit(value(k, c)) for k in range(count)]), F.floor(x * count / w).cast("int"))
    return pictures(spark, n, w, h, [lambda x, y, k, c=c: pick(x, c) for c in range(3)])


def pal75bars(spark: SparkSession, n: int, w: int, h: int) -> DataFrame:
    return bars(spark, n, w, h, 0.75, 8)


def pal100bars(spark: SparkSession, n: int, w: int, h: int) -> DataFrame:
    return bars(spark, n, w, h, 1.0, 8)


def smptebars(spark: SparkSession, n: int, w: int, h: int) -> DataFrame:
    """Two thirds of bars at 75 per cent, a twelfth of the blue ones backwards, the rest dark."""
    top = bars(spark, n, w, h)
    reverse = (6, 7, 4, 7, 2, 7, 0)

    def plane(c: int) -> Callable[[Column, Column, Column], Column]:
        bar = lambda x: F.floor(x * 7 / w).cast("int")
        upper = F.array(*[F.lit(round(255 * 0.75) * BARS[k][c]) for k in range(7)])
        middle = F.array(*[F.lit(round(255 * 0.75) * BARS[k][c]) for k in reverse])
        return lambda x, y, k: F.when(y < h * 2 // 3, F.get(upper, bar(x))).when(y < h * 3 // 4, F.get(middle, bar(x))).otherwise(F.when((x >= w * 5 // 28) & (x < w * 10 // 28), 255).otherwise(0))

    return pictures(top.sparkSession, n, w, h, [plane(c) for c in range(3)])


def haldclutsrc(spark: SparkSession, level: int = 6) -> DataFrame:
    """One picture with the colours of a cube of side level ** 2 in order, red the fastest."""
    side, cube = level**3, level**2
    place = lambda x, y, k: F.floor((y * side + x) / cube**k) % cube
    return pictures(spark, 1, side, side, [lambda x, y, n, k=k: F.floor(place(x, y, k) * 255 / (cube - 1) + 0.5) for k in range(3)])


def colorspectrum(spark: SparkSession, n: int, w: int, h: int, type: str = "black") -> DataFrame:
    """Hues from left to right, from full colour at the bottom to black, or to white, at the top."""
    hue = lambda x, shift: limit01(F.abs((F.pmod(x / w * 6 + shift, F.lit(6.0))) - 3) - 1)
    share = lambda y: y / max(1, h - 1)
    mix = (lambda v, y: v * share(y)) if type == "black" else (lambda v, y: 1 - (1 - v) * share(y))
    return pictures(spark, n, w, h, [lambda x, y, k, s=s: byte(mix(hue(x, s), y) * 255) for s in (0.0, 4.0, 2.0)])


def limit01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gradients(spark: SparkSession, n: int, w: int, h: int, c0: tuple[int, int, int] = (0, 0, 0), c1: tuple[int, int, int] = (255, 255, 255), speed: float = 0.01) -> DataFrame:
    """From one colour to another along a line that turns by ``speed`` radians a frame."""

    def plane(c: int) -> Callable[[Column, Column, Column], Column]:
        def pixel(x: Column, y: Column, k: Column) -> Column:
            angle = k * speed
            t = limit01(0.5 + ((x - (w - 1) / 2) * F.cos(angle) + (y - (h - 1) / 2) * F.sin(angle)) / max(w, h))
            return byte(c0[c] + t * (c1[c] - c0[c]))

        return pixel

    return pictures(spark, n, w, h, [plane(c) for c in range(3)])


def zoneplate(spark: SparkSession, n: int, w: int, h: int, kx2: float = 1.0, ky2: float = 1.0, kt: float = 0.0) -> DataFrame:
    """A sine of the squared distances from the middle, and of time."""
    phase = lambda x, y, k: (kx2 * F.pow(x - w / 2, 2) + ky2 * F.pow(y - h / 2, 2)) * math.pi / max(w, h) + kt * k
    return pictures(spark, n, w, h, [lambda x, y, k: byte(127.5 + 127.5 * F.sin(phase(x, y, k)))])


def mandelbrot(spark: SparkSession, n: int, w: int, h: int, maxiter: int = 64, x0: float = -0.75, y0: float = 0.0, scale: float = 3.0, zoom: float = 0.9) -> DataFrame:
    """How many steps a point takes to leave, of ``maxiter``, as a share of 255; each frame is ``zoom`` times as wide."""

    def pixel(x: Column, y: Column, k: Column) -> Column:
        s = scale * F.pow(F.lit(zoom), k.cast("double"))
        cx, cy = x0 + ((x + 0.5) / w - 0.5) * s, y0 + ((y + 0.5) / h - 0.5) * s * h / w
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

        def step(z: Column, _: Column) -> Column:
            on = z["a"] * z["a"] + z["b"] * z["b"] <= 4
            return F.struct(F.when(on, z["a"] * z["a"] - z["b"] * z["b"] + cx).otherwise(z["a"]).alias("a"), F.when(on, 2 * z["a"] * z["b"] + cy).otherwise(z["b"]).alias("b"), (z["n"] + on.cast("int")).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(maxiter)), start, step, lambda z: F.floor(z["n"] * 255 / maxiter))

    return pictures(spark, n, w, h, [pixel])


def sierpinski(spark: SparkSession, n: int, w: int, h: int, type: str = "carpet") -> DataFrame:
    """carpet: black where any ternary digit of x and y is 1 in both; triangle: where x and y share a bit."""
    if type == "triangle":
        return pictures(spark, n, w, h, [lambda x, y, k: F.when(x.cast("long").bitwiseAND(y.cast("long")) == 0, 255).otherwise(0)])
    digits = math.ceil(math.log(max(w, h, 2), 3)) + 1
    hole = lambda x, y: F.exists(F.sequence(F.lit(0), F.lit(digits)), lambda d: (F.floor(x / F.pow(F.lit(3.0), d)) % 3 == 1) & (F.floor(y / F.pow(F.lit(3.0), d)) % 3 == 1))
    return pictures(spark, n, w, h, [lambda x, y, k: F.when(hole(x, y), 0).otherwise(255)])


def cellauto(spark: SparkSession, w: int, h: int, rule: int = 110, pattern: str | None = None, stitch: bool = True) -> DataFrame:
    """One picture: a row of cells, and below it the next one by an elementary rule, and so on. Cells: the characters of ``pattern`` but blanks,
    in the middle, or one in the middle. stitch: the ends meet."""
    first = [0] * w
    for k, c in enumerate((pattern or "x")[:w]):
        first[(w - len((pattern or "x")[:w])) // 2 + k] = int(c != " ")
    bits = F.array(*[F.lit(rule >> k & 1) for k in range(8)])

    def following(row: Column) -> Column:
        cell = lambda i: F.get(row, F.pmod(i, F.lit(w))) if stitch else F.coalesce(F.get(row, F.when((i >= 0) & (i < w), i)), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.get(bits, (4 * cell(i - 1) + 2 * cell(i) + cell(i + 1)).cast("int")))

    start = F.array(F.array(*map(F.lit, first)))
    rows = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, h - 1))), start, lambda rs, _: F.concat(rs, F.array(following(F.element_at(rs, -1)))))
    flat = F.transform(F.flatten(F.slice(rows, 1, h)), lambda v: v * 255)
    return spark.range(1).select(F.col("id").alias("n"), F.lit(w).alias("w"), F.lit(h).alias("h"), flat.alias("p0"))


def life(spark: SparkSession, n: int, w: int, h: int, cells: list[tuple[int, int]], born: tuple[int, ...] = (3,), stay: tuple[int, ...] = (2, 3), stitch: bool = True) -> DataFrame:
    """(n, w, h, p0): ``n`` generations of cells (x, y), alive ones 255. stitch: opposite edges meet."""
    alive = {y * w + x for x, y in cells}
    start = F.array(F.array(*[F.lit(int(k in alive)) for k in range(w * h)]))

    def following(g: Column) -> Column:
        def cell(x: Column, y: Column) -> Column:
            if stitch:
                return F.get(g, (F.pmod(y, F.lit(h)) * w + F.pmod(x, F.lit(w))).cast("int"))
            return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(g, (y * w + x).cast("int"))).otherwise(0)

        def pixel(x: Column, y: Column) -> Column:
            near = sum((cell(x + dx, y + dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy), F.lit(0))
            return F.when(cell(x, y) == 1, near.isin(*stay)).otherwise(near.isin(*born)).cast("int")

        return draw(F.lit(w), F.lit(h), pixel)

    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n - 1))), start, lambda gs, _: F.concat(gs, F.array(following(F.element_at(gs, -1)))))
    rows = spark.range(1).select(F.posexplode(F.slice(all_, 1, n)).alias("n", "g"))
    return rows.select(F.col("n").cast("long").alias("n"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.transform("g", lambda v: v * 255).alias("p0"))


def perlin(spark: SparkSession, n: int, w: int, h: int, octaves: int = 1, persistence: float = 1.0, scale: float = 8.0, seed: int = 0) -> DataFrame:
    """Smooth noise: values at the corners of a grid, by hashes of their places and the seed, blended between them; octaves of half the size are added."""

    def layer(x: Column, y: Column, k: Column, size: float, salt: int) -> Column:
        u, v = x / size, y / size
        i, j = F.floor(u), F.floor(v)
        a, b = u - i, v - j
        fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
        at = lambda p, q: F.pmod(F.xxhash64(p, q, k, F.lit(seed + salt)), F.lit(1 << 20)) / float(1 << 20)
        top = at(i, j) * (1 - fade(a)) + at(i + 1, j) * fade(a)
        return top * (1 - fade(b)) + (at(i, j + 1) * (1 - fade(a)) + at(i + 1, j + 1) * fade(a)) * fade(b)

    total = sum(persistence**o for o in range(octaves))
    return pictures(spark, n, w, h, [lambda x, y, k: byte(sum((layer(x, y, k, scale / 2**o, o) * persistence**o for o in range(octaves)), F.lit(0.0)) / total * 255)])

