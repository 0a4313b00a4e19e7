"""Filters on pixels, as expressions over array columns: no Python worker, and a frame never leaves its row.

A frame is a row with its width ``w``, height ``h`` and planes ``p0``, ``p1`` .. (arrays of 8-bit values, row by row, all
of the frame's size). Beyond an edge the nearest pixel counts, if nothing else is said. A filter takes one or several
``Frame`` and gives one; ``FILTERS`` lists them by name, ``apply`` runs one on DataFrames. A null plane stays null, and
an empty one (no pixels) stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import to_column


@dataclass(frozen=True)
class Frame:
    w: Column
    h: Column
    planes: tuple[Column, ...]

    def each(self, f: Callable[[Column], Column], mask: int = 15) -> Frame:
        """``f`` of every plane that ``mask`` has a bit for."""
        return replace(self, planes=tuple(f(p) if mask >> k & 1 else p for k, p in enumerate(self.planes)))


FILTERS: dict[str, Callable[..., Frame]] = {}


def named(*names: str):
    def keep(f):
        for n in names:
            FILTERS[n] = f
        return f

    return keep


def _int(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def draw(w: Column, h: Column, f: Callable[[Column, Column], Column]) -> Column:
    """A plane of the values that ``f`` gives for each (x, y)."""
    pixel = lambda i: f(i % w, F.floor(i / w).cast("int")).cast("int")
    return F.when(w * h > 0, F.transform(F.sequence(F.lit(0), w * h - 1), pixel)).otherwise(F.array().cast("array<int>"))


def limit(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def at(p: Column, w: Column, h: Column, x: Column, y: Column) -> Column:
    """The pixel nearest to (x, y)."""
    return F.get(p, (limit(y, F.lit(0), h - 1) * w + limit(x, F.lit(0), w - 1)).cast("int"))


def byte(x: Column) -> Column:
    """Rounded, halves up, and limited to 0..255."""
    return limit(F.floor(x + 0.5), F.lit(0), F.lit(255))


def each_of(p: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(value, place)`` of an array's elements, as whole numbers; ``f`` may have further parameters with defaults."""
    return F.transform(p, lambda v, i: f(v, i).cast("int"))


def gather(f: Frame, w: Column, h: Column, source: Callable[[Column, Column], tuple[Column, Column]]) -> Frame:
    """A frame of size (w, h), each pixel taken from ``source(x, y)``."""
    return Frame(w, h, tuple(F.when(p.isNotNull(), draw(w, h, lambda x, y, p=p: at(p, f.w, f.h, *source(x, y)))) for p in f.planes))


def pointwise(value: Callable[..., Column], *frames: Frame, mask: int = 15) -> Frame:
    """``value`` of the pixels of all frames at one place, plane by plane."""
    a = frames[0]
    out = []
    for k, p in enumerate(a.planes):
        others = [f.planes[min(k, len(f.planes) - 1)] for f in frames[1:]]
        if not mask >> k & 1:
            out.append(p)
        elif not others:
            out.append(each_of(p, lambda v, i: value(v)))
        else:
            out.append(each_of(p, lambda v, i, o=others: value(v, *[F.get(q, i) for q in o])))
    return replace(a, planes=tuple(out))


def mixed(f: Frame, value: Callable[..., Column]) -> Frame:
    """``value`` of all components of a pixel gives a list of new ones."""
    n = len(f.planes)
    return replace(f, planes=tuple(each_of(f.planes[k], lambda v, i, k=k: value(*[v if j == k else F.get(f.planes[j], i) for j in range(n)])[k]) for k in range(n)))


# Geometry


@named("hflip")
def hflip(f: Frame) -> Frame:
    return gather(f, f.w, f.h, lambda x, y: (f.w - 1 - x, y))


@named("vflip")
def vflip(f: Frame) -> Frame:
    return gather(f, f.w, f.h, lambda x, y: (x, f.h - 1 - y))


@named("transpose")
def transpose(f: Frame, dir: str = "cclock_flip") -> Frame:
    turn = {
        "cclock_flip": lambda x, y: (y, x), "clock": lambda x, y: (y, f.h - 1 - x),
        "cclock": lambda x, y: (f.w - 1 - y, x), "clock_flip": lambda x, y: (f.w - 1 - y, f.h - 1 - x),
    }[dir]
    return gather(f, f.h, f.w, turn)


@named("crop")
def crop(f: Frame, out_w: int, out_h: int, x: int | None = None, y: int | None = None) -> Frame:
    """The middle by default. A rectangle that doesn't fit is moved inside."""
    w, h = F.least(F.lit(out_w), f.w), F.least(F.lit(out_h), f.h)
    left = limit(F.floor((f.w - w) / 2) if x is None else F.lit(x), F.lit(0), f.w - w)
    top = limit(F.floor((f.h - h) / 2) if y is None else F.lit(y), F.lit(0), f.h - h)
    return gather(f, w, h, lambda i, j: (i + left, j + top))


@named("pad")
def pad(f: Frame, width: int, height: int, x: int = 0, y: int = 0, color: tuple[int, ...] = (0, 0, 0, 255)) -> Frame:
    w, h = F.greatest(f.w, F.lit(width)), F.greatest(f.h, F.lit(height))
    inside = lambda i, j: (i >= x) & (i < f.w + x) & (j >= y) & (j < f.h + y)
    return Frame(w, h, tuple(draw(w, h, lambda i, j, p=p, k=k: F.when(inside(i, j), at(p, f.w, f.h, i - x, j - y)).otherwise(color[k])) for k, p in enumerate(f.planes)))


@named("scale")
def scale(f: Frame, width: int, height: int, flags: str = "bilinear") -> Frame:
    """``neighbor`` or ``bilinear``, pixel centres at halves."""
    w, h = F.lit(width), F.lit(height)
    u, v = lambda x: (x + 0.5) * f.w / width - 0.5, lambda y: (y + 0.5) * f.h / height - 0.5
    if flags == "neighbor":
        return gather(f, w, h, lambda x, y: (F.floor(u(x) + 0.5), F.floor(v(y) + 0.5)))
    if flags != "bilinear":
        raise ValueError("flags is neighbor or bilinear")
    return Frame(w, h, tuple(F.when(p.isNotNull(), draw(w, h, lambda x, y, p=p: byte(between(p, f, u(x), v(y))))) for p in f.planes))


def between(p: Column, f: Frame, x: Column, y: Column) -> Column:
    """The value at a place between pixels, linear in both directions."""
    i, j = F.floor(x), F.floor(y)
    a, b = x - i, y - j
    top = at(p, f.w, f.h, i, j) * (1 - a) + at(p, f.w, f.h, i + 1, j) * a
    return top * (1 - b) + (at(p, f.w, f.h, i, j + 1) * (1 - a) + at(p, f.w, f.h, i + 1, j + 1) * a) * b


@named("rotate")
def rotate(f: Frame, angle: float, fill: tuple[int, ...] = (0, 0, 0, 255), bilinear: bool = True) -> Frame:
    """About the centre, clockwise for positive angles in radians; the size stays, ``fill`` is what comes from outside."""
    s, c = math.sin(angle), math.cos(angle)
    cx, cy = (f.w - 1) / 2, (f.h - 1) / 2
    u, v = lambda x, y: (x - cx) * c + (y - cy) * s + cx, lambda x, y: (y - cy) * c - (x - cx) * s + cy
    near = 1e-9

    def value(p: Column, k: int):
        def pixel(x: Column, y: Column) -> Column:
            a, b = u(x, y), v(x, y)
            inside = (a >= -near) & (a <= f.w - 1 + near) & (b >= -near) & (b <= f.h - 1 + near)
            found = byte(between(p, f, limit(a, F.lit(0.0), f.w - 1.0), limit(b, F.lit(0.0), f.h - 1.0))) if bilinear else at(p, f.w, f.h, F.floor(a + 0.5), F.floor(b + 0.5))
            return F.when(inside, found).otherwise(fill[k])

        return pixel

    return replace(f, planes=tuple(draw(f.w, f.h, value(p, k)) for k, p in enumerate(f.planes)))


@named("perspective")
def perspective(f: Frame, x0: float, y0: float, x1: float, y1: float, x2: float, y2: float, x3: float, y3: float) -> Frame:
    """The four corners (top left, top right, bottom left, bottom right) of the part of the input that fills the output."""
    dx1, dy1, dx2, dy2 = x1 - x3, y1 - y3, x2 - x3, y2 - y3
    sx, sy = x0 - x1 + x3 - x2, y0 - y1 + y3 - y2
    den = dx1 * dy2 - dx2 * dy1
    if not den:
        raise ValueError("the corners lie on a line")
    g, q = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    a, b, d, e = x1 - x0 + g * x1, x2 - x0 + q * x2, y1 - y0 + g * y1, y2 - y0 + q * y2

    def source(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x / f.w, y / f.h
        z = 1 + g * u + q * v
        return (a * u + b * v + x0) / z, (d * u + e * v + y0) / z

    return replace(f, planes=tuple(draw(f.w, f.h, lambda x, y, p=p: byte(between(p, f, *source(x, y)))) for p in f.planes))


@named("field")
def field(f: Frame, type: str = "top") -> Frame:
    first = 0 if type == "top" else 1
    return gather(f, f.w, F.floor((f.h + 1 - first) / 2), lambda x, y: (x, 2 * y + first))


@named("il")
def il(f: Frame, luma_mode: str = "none", chroma_mode: str = "none", alpha_mode: str = "none", luma_swap: bool = False, chroma_swap: bool = False, alpha_swap: bool = False) -> Frame:
    """Rows of one parity above those of the other (deinterleave), or back; an odd last row stays."""
    modes = [(luma_mode, luma_swap), (chroma_mode, chroma_swap), (chroma_mode, chroma_swap), (alpha_mode, alpha_swap)]
    half = F.floor(f.h / 2)
    out = []
    for p, (mode, swap) in zip(f.planes, modes, strict=False):
        first = 1 if swap else 0
        if mode in ("deinterleave", "d"):
            row = lambda y, a=first: F.when(y < half, 2 * y + a).otherwise(2 * (y - half) + 1 - a)
        elif mode in ("interleave", "i"):
            row = lambda y, a=first: F.when(y % 2 == a, F.floor(y / 2)).otherwise(half + F.floor(y / 2))
        else:
            out.append(p)
            continue
        out.append(draw(f.w, f.h, lambda x, y, p=p, row=row: at(p, f.w, f.h, x, F.when(y >= 2 * half, y).otherwise(row(y)))))
    return replace(f, planes=tuple(out))


@named("scroll")
def scroll(f: Frame, n: int | Column = 0, horizontal: float = 0.0, vertical: float = 0.0, hpos: float = 0.0, vpos: float = 0.0) -> Frame:
    """Rolled by a share of the size for each frame before; ``n`` is the frame's number."""
    move = lambda pos, speed, size: F.floor(F.pmod((F.lit(pos) + _int(n) * speed) * size, size.cast("double")))
    return gather(f, f.w, f.h, lambda x, y: ((x + move(hpos, horizontal, f.w)) % f.w, (y + move(vpos, vertical, f.h)) % f.h))


@named("swaprect")
def swaprect(f: Frame, w: int, h: int, x1: int, y1: int, x2: int, y2: int) -> Frame:
    """Two rectangles change places; where they overlap the second one's content counts."""
    inside = lambda x, y, a, b: (x >= a) & (x < a + w) & (y >= b) & (y < b + h)
    pick = lambda x, y: [F.when(inside(x, y, x2, y2), c + p - q).when(inside(x, y, x1, y1), c + q - p).otherwise(c) for c, p, q in ((x, x1, x2), (y, y1, y2))]
    return gather(f, f.w, f.h, lambda x, y: tuple(pick(x, y)))


@named("fillborders")
def fillborders(f: Frame, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0, mode: str = "smear", color: tuple[int, ...] = (0, 0, 0, 255)) -> Frame:
    """Borders from the inside: the edge (smear), mirrored, wrapped around, or of a fixed colour."""
    if mode not in ("smear", "mirror", "wrap", "fixed"):
        raise ValueError("mode is smear, mirror, wrap or fixed")

    def inner(c: Column, size: Column, low: int, high: int) -> Column:
        end = size - high
        before, after = {
            "smear": (F.lit(low), end - 1), "fixed": (c, c), "mirror": (2 * low - 1 - c, 2 * end - 1 - c),
            "wrap": (end - 1 - (low - 1 - c) % F.greatest(F.lit(1), end - low), low + (c - end) % F.greatest(F.lit(1), end - low)),
        }[mode]
        return F.when(c < low, before).when(c >= end, after).otherwise(c)

    filled = gather(f, f.w, f.h, lambda x, y: (inner(x, f.w, left, right), inner(y, f.h, top, bottom)))
    if mode != "fixed":
        return filled
    border = lambda x, y: (x < left) | (x >= f.w - right) | (y < top) | (y >= f.h - bottom)
    return replace(f, planes=tuple(draw(f.w, f.h, lambda x, y, p=p, k=k: F.when(border(x, y), color[k]).otherwise(at(p, f.w, f.h, x, y))) for k, p in enumerate(f.planes)))


@named("pixelize")
def pixelize(f: Frame, width: int = 16, height: int = 16, mode: str = "avg", planes: int = 15) -> Frame:
    """Each block becomes its mean (rounded down), least or greatest value."""
    across, down = F.ceil(f.w / width), F.ceil(f.h / height)

    def blocks(p: Column) -> Column:
        def block(bx: Column, by: Column) -> Column:
            wide, high = F.least(F.lit(width), f.w - bx * width), F.least(F.lit(height), f.h - by * height)
            held = F.transform(F.sequence(F.lit(0).cast("long"), (wide * high - 1).cast("long")), lambda k: at(p, f.w, f.h, bx * width + k % wide, by * height + F.floor(k / wide)))
            if mode == "avg":
                return F.floor(F.aggregate(held, F.lit(0), lambda a, v: a + v) / (wide * high))
            return {"min": F.array_min, "max": F.array_max}[mode](held)

        return draw(across, down, block)

    def plane(p: Column) -> Column:
        return let(blocks(p), lambda b: draw(f.w, f.h, lambda x, y: F.get(b, (F.floor(y / height) * across + F.floor(x / width)).cast("int"))))

    return f.each(plane, planes)


@named("untile")
def untile(f: Frame, k: int | Column, columns: int, rows: int) -> Frame:
    """The k-th cell of a grid; see ``untiled`` for all of them."""
    w, h = F.floor(f.w / columns), F.floor(f.h / rows)
    return gather(f, w, h, lambda x, y: (x + (_int(k) % columns) * w, y + F.floor(_int(k) / columns) * h))


@named("epx")
def epx(f: Frame, n: int = 2) -> Frame:
    """Twice the size; a corner takes its neighbours' value where these are equal and the others differ."""
    if n != 2:
        raise ValueError("twice the size only")

    def plane(p: Column) -> Column:
        def pixel(x: Column, y: Column) -> Column:
            i, j = F.floor(x / 2), F.floor(y / 2)
            v = lambda dx, dy: at(p, f.w, f.h, i + dx, j + dy)
            here, up, right, left, down = v(0, 0), v(0, -1), v(1, 0), v(-1, 0), v(0, 1)
            corner = lambda a, b, c, d: F.when((a == b) & (a != c) & (b != d), a).otherwise(here)
            top = F.when(x % 2 == 0, corner(left, up, down, right)).otherwise(corner(up, right, left, down))
            return F.when(y % 2 == 0, top).otherwise(F.when(x % 2 == 0, corner(down, left, right, up)).otherwise(corner(right, down, up, left)))

        return draw(2 * f.w, 2 * f.h, pixel)

    return Frame(2 * f.w, 2 * f.h, tuple(plane(p) for p in f.planes))


# Planes


@named("shuffleplanes")
def shuffleplanes(f: Frame, map0: int = 0, map1: int = 1, map2: int = 2, map3: int = 3) -> Frame:
    return replace(f, planes=tuple(f.planes[m] for m, _ in zip((map0, map1, map2, map3), f.planes, strict=False)))


@named("swapuv")
def swapuv(f: Frame) -> Frame:
    return replace(f, planes=(f.planes[0], f.planes[2], f.planes[1], *f.planes[3:]))


@named("extractplanes")
def extractplanes(f: Frame, planes: int = 0) -> Frame:
    return replace(f, planes=(f.planes[planes],))


@named("alphaextract")
def alphaextract(f: Frame) -> Frame:
    return replace(f, planes=(f.planes[3],))


@named("alphamerge")
def alphamerge(f: Frame, g: Frame) -> Frame:
    return replace(f, planes=(*f.planes[:3], g.planes[0]))


@named("mergeplanes")
def mergeplanes(*frames: Frame, mapping: tuple[tuple[int, int], ...] = ((0, 0),)) -> Frame:
    """mapping: (input, plane) for each plane of the output."""
    return replace(frames[0], planes=tuple(frames[s].planes[p] for s, p in mapping))


# Neighbourhoods

#: The eight neighbours (dx, dy) in the order of the bits of ``coordinates``.
AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def stencil(f: Frame, value: Callable[[Callable[[int, int], Column]], Column], mask: int = 15) -> Frame:
    """``value`` of a function that gives the neighbour at (dx, dy)."""
    return f.each(lambda p: draw(f.w, f.h, lambda x, y: value(lambda dx, dy: at(p, f.w, f.h, x + dx, y + dy))), mask)


def _weighted(v: Callable, kernel: list[float], size: int) -> Column:
    r = size // 2
    terms = [v(k % size - r, k // size - r) * float(c) for k, c in enumerate(kernel) if c]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


@named("convolution")
def convolution(f: Frame, matrix: str = "0 0 0 0 1 0 0 0 0", rdiv: float = 0.0, bias: float = 0.0, mode: str = "square", planes: int = 15) -> Frame:
    """The weighted sum of a neighbourhood over ``rdiv`` (0: the sum of the weights, or 1 if that is 0), plus ``bias``."""
    kernel = [float(x) for x in matrix.split()]
    by = rdiv or sum(kernel) or 1.0
    n = len(kernel)
    if mode == "square":
        size = math.isqrt(n)
        if size * size != n or size % 2 == 0:
            raise ValueError("a square matrix of an odd size is needed")
        return stencil(f, lambda v: byte(_weighted(v, kernel, size) / by + bias), planes)
    if n % 2 == 0:
        raise ValueError("an odd number of weights is needed")
    place = (lambda v, k: v(k - n // 2, 0)) if mode == "row" else (lambda v, k: v(0, k - n // 2))
    return stencil(f, lambda v: byte(sum((place(v, k) * c for k, c in enumerate(kernel)), F.lit(0.0)) / by + bias), planes)


#: Gradients across of the edge operators (those down are their transposes), and what sums are divided by.
GRADIENTS = {"sobel": ((-1, 0, 1, -2, 0, 2, -1, 0, 1), 1.0), "prewitt": ((-1, 0, 1, -1, 0, 1, -1, 0, 1), 1.0), "scharr": ((-3, 0, 3, -10, 0, 10, -3, 0, 3), 16.0)}


def _edges(name: str):
    across, by = GRADIENTS[name]
    down = [across[3 * (k % 3) + k // 3] for k in range(9)]

    def run(f: Frame, planes: int = 15, scale: float = 1.0, delta: float = 0.0) -> Frame:
        size = lambda v: F.sqrt(F.pow(_weighted(v, across, 3) / by, 2) + F.pow(_weighted(v, down, 3) / by, 2))
        return stencil(f, lambda v: byte(size(v) * scale + delta), planes)

    run.__doc__ = f"The length of the gradient by {name}'s operator."
    return run


for _name in GRADIENTS:
    FILTERS[_name] = _edges(_name)


@named("roberts")
def roberts(f: Frame, planes: int = 15, scale: float = 1.0, delta: float = 0.0) -> Frame:
    size = lambda v: F.sqrt(F.pow(v(0, 0) - v(1, 1).cast("double"), 2) + F.pow(v(1, 0) - v(0, 1).cast("double"), 2))
    return stencil(f, lambda v: byte(size(v) * scale + delta), planes)


def _kirsch_masks() -> list[list[int]]:
    """Three neighbours of the ring weigh 5, the other five -3; turned in eight directions."""
    ring = ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1))
    masks = []
    for turn in range(8):
        mask = [0] * 9
        for k, (x, y) in enumerate(ring):
            mask[3 * y + x] = 5 if (k - turn) % 8 < 3 else -3
        masks.append(mask)
    return masks


@named("kirsch")
def kirsch(f: Frame, planes: int = 15, scale: float = 1.0, delta: float = 0.0, divisor: float = 3.0) -> Frame:
    """The greatest of the responses in eight directions, over ``divisor``."""
    return stencil(f, lambda v: byte(F.greatest(*[_weighted(v, m, 3) for m in _kirsch_masks()]) / divisor * scale + delta), planes)


@named("dilation")
def dilation(f: Frame, coordinates: int = 255, thresholds: tuple[int, ...] = (65535,) * 4) -> Frame:
    """The greatest of a pixel and those neighbours that ``coordinates`` has bits for, ``thresholds`` above it at most."""
    return _extreme(f, coordinates, thresholds, F.greatest, lambda x, here, t: F.least(x, here + t))


@named("erosion")
def erosion(f: Frame, coordinates: int = 255, thresholds: tuple[int, ...] = (65535,) * 4) -> Frame:
    return _extreme(f, coordinates, thresholds, F.least, lambda x, here, t: F.greatest(x, here - t))


def _extreme(f: Frame, coordinates: int, thresholds: tuple[int, ...], choose, held) -> Frame:
    own = [o for k, o in enumerate(AROUND) if coordinates >> k & 1]
    out = f
    for k in range(len(f.planes)):
        value = lambda v, t=thresholds[k]: limit(held(choose(v(0, 0), *[v(*o) for o in own]) if own else v(0, 0), v(0, 0), t), F.lit(0), F.lit(255))
        out = stencil(out, value, 1 << k)
    return out


@named("inflate")
def inflate(f: Frame, thresholds: tuple[int, ...] = (65535,) * 4) -> Frame:
    """The mean of the neighbours, rounded down, where it is greater."""
    return _mean_step(f, thresholds, lambda m, here, t: F.when(m > here, F.least(m, here + t)).otherwise(here))


@named("deflate")
def deflate(f: Frame, thresholds: tuple[int, ...] = (65535,) * 4) -> Frame:
    return _mean_step(f, thresholds, lambda m, here, t: F.when(m < here, F.greatest(m, here - t)).otherwise(here))


def _mean_step(f: Frame, thresholds: tuple[int, ...], held) -> Frame:
    out = f
    for k in range(len(f.planes)):
        out = stencil(out, lambda v, t=thresholds[k]: held(F.floor(sum((v(*o) for o in AROUND[1:]), v(*AROUND[0])) / 8), v(0, 0), t), 1 << k)
    return out


@named("median")
def median(f: Frame, radius: int = 1, radius_v: int = 0, percentile: float = 0.5, planes: int = 15) -> Frame:
    """The value of a rank within the neighbourhood; ``radius_v`` 0: as ``radius``."""
    rv = radius_v or radius
    n = (2 * radius + 1) * (2 * rv + 1)
    rank = math.floor(percentile * (n - 1) + 0.5)
    around = lambda v: F.array(*[v(dx, dy) for dy in range(-rv, rv + 1) for dx in range(-radius, radius + 1)])
    return stencil(f, lambda v: F.get(F.array_sort(around(v)), F.lit(rank)), planes)


def _box_sums(p: Column, f: Frame, rx: int, ry: int, then: Callable[[Column, Column, Column], Column]) -> Column:
    """Sums over boxes by rows, then by columns; ``then(x, y, sum)``."""
    across = draw(f.w, f.h, lambda x, y: sum((at(p, f.w, f.h, x + d, y) for d in range(-rx + 1, rx + 1)), at(p, f.w, f.h, x - rx, y)))
    return let(across, lambda q: draw(f.w, f.h, lambda x, y: then(x, y, sum((at(q, f.w, f.h, x, y + d) for d in range(-ry + 1, ry + 1)), at(q, f.w, f.h, x, y - ry)))))


@named("avgblur")
def avgblur(f: Frame, size_x: int = 1, size_y: int = 0, planes: int = 15) -> Frame:
    """The mean of a box, rounded down."""
    ry = size_y if size_y > 0 else size_x
    n = (2 * size_x + 1) * (2 * ry + 1)
    return f.each(lambda p: _box_sums(p, f, size_x, ry, lambda x, y, s: F.floor(s / n)), planes)


@named("boxblur")
def boxblur(f: Frame, luma_radius: int = 2, luma_power: int = 2, chroma_radius: int | None = None, chroma_power: int = -1, alpha_radius: int | None = None, alpha_power: int = -1) -> Frame:
    """The mean of a box, rounded to the nearest, ``power`` times over. Chroma and alpha take luma's values by default."""
    pick = lambda r, n: (luma_radius if r is None else r, luma_power if n < 0 else n)
    params = [(luma_radius, luma_power), pick(chroma_radius, chroma_power), pick(chroma_radius, chroma_power), pick(alpha_radius, alpha_power)]

    def blurred(p: Column, r: int, power: int) -> Column:
        n = (2 * r + 1) ** 2
        once = lambda q: _box_sums(q, f, r, r, lambda x, y, s: F.floor((2 * s + n) / (2 * n)))
        return p if power <= 0 or r <= 0 else once(p) if power == 1 else let(once(p), lambda q: blurred(q, r, power - 1))

    return replace(f, planes=tuple(blurred(p, *params[k]) for k, p in enumerate(f.planes)))


@named("unsharp")
def unsharp(f: Frame, luma_msize_x: int = 5, luma_msize_y: int = 5, luma_amount: float = 1.0, chroma_msize_x: int = 5, chroma_msize_y: int = 5, chroma_amount: float = 0.0) -> Frame:
    """A pixel plus ``amount`` times its difference to the mean of a box; negative amounts blur."""
    params = [(luma_msize_x, luma_msize_y, luma_amount)] + [(chroma_msize_x, chroma_msize_y, chroma_amount)] * 2 + [(1, 1, 0.0)]

    def plane(p: Column, sx: int, sy: int, amount: float) -> Column:
        rx, ry = (sx - 1) // 2, (sy - 1) // 2
        n = (2 * rx + 1) * (2 * ry + 1)
        here = lambda x, y: at(p, f.w, f.h, x, y)
        return p if not amount else _box_sums(p, f, rx, ry, lambda x, y, s: byte(here(x, y) + amount * (here(x, y) - F.floor((2 * s + n) / (2 * n)))))

    return replace(f, planes=tuple(plane(p, *params[k]) for k, p in enumerate(f.planes)))


@named("gblur")
def gblur(f: Frame, sigma: float = 0.5, sigma_v: float = -1.0, steps: int = 1, planes: int = 15) -> Frame:
    """A Gaussian by rows, then by columns, each rounded; reach: four sigma."""

    def weights(s: float) -> list[float]:
        r = max(1, math.ceil(4 * s)) if s > 0 else 0
        w = [math.exp(-k * k / (2 * s * s)) if s > 0 else 1.0 for k in range(-r, r + 1)]
        return [x / sum(w) for x in w]

    wx, wy = weights(sigma), weights(sigma if sigma_v < 0 else sigma_v)
    along = lambda p, w, place: draw(f.w, f.h, lambda x, y: byte(sum((place(p, x, y, k - len(w) // 2) * c for k, c in enumerate(w)), F.lit(0.0))))

    def once(p: Column, left: int) -> Column:
        rows = along(p, wx, lambda q, x, y, d: at(q, f.w, f.h, x + d, y))
        columns = let(rows, lambda q: along(q, wy, lambda q, x, y, d: at(q, f.w, f.h, x, y + d)))
        return columns if left <= 1 else let(columns, lambda q: once(q, left - 1))

    return f.each(lambda p: once(p, steps), planes)


@named("guided")
def guided(f: Frame, radius: int = 3, eps: float = 0.01, planes: int = 1) -> Frame:
    """Edge-preserving smoothing, guided by the plane itself: means of a and b in I' = a I + b, a = var / (var + eps)."""
    n = (2 * radius + 1) ** 2
    e = eps * 255 * 255

    def plane(p: Column) -> Column:
        squares = F.transform(p, lambda v: v * v)
        mean = _box(p, f, radius)

        def lines(m: Column, s: Column) -> Column:
            var = lambda i: F.get(s, i) / n - F.pow(F.get(m, i) / n, 2)
            a = F.transform(m, lambda _, i: var(i) / (var(i) + e))
            return let(a, lambda a: let(F.transform(m, lambda v, i: v / n * (1 - F.get(a, i))), lambda b: let(_box(a, f, radius), lambda ma: let(_box(b, f, radius), lambda mb: F.transform(p, lambda v, i: byte((F.get(ma, i) * v + F.get(mb, i)) / n).cast("int"))))))

        return let(mean, lambda m: let(squares, lambda q: let(_box(q, f, radius), lambda s: lines(m, s))))

    return f.each(plane, planes)


def _box(p: Column, f: Frame, r: int) -> Column:
    """Sums over boxes, as doubles."""
    grid = lambda value: F.transform(F.sequence(F.lit(0), f.w * f.h - 1), lambda i: value(i % f.w, F.floor(i / f.w)).cast("double"))
    across = grid(lambda x, y: sum((at(p, f.w, f.h, x + d, y) for d in range(-r + 1, r + 1)), at(p, f.w, f.h, x - r, y)))
    return let(across, lambda q: grid(lambda x, y: sum((at(q, f.w, f.h, x, y + d) for d in range(-r + 1, r + 1)), at(q, f.w, f.h, x, y - r))))


@named("morpho")
def morpho(f: Frame, mode: str = "erode", structure: tuple[tuple[int, int], ...] = ((0, 0), *AROUND), planes: int = 7) -> Frame:
    """Erosion and dilation by a structure of offsets, and what is made of them."""
    least = lambda g: stencil(g, lambda v: F.least(*[v(*o) for o in structure], v(*structure[0])), planes)
    most = lambda g: stencil(g, lambda v: F.greatest(*[v(*o) for o in structure], v(*structure[0])), planes)

    def then(g: Frame, step) -> Frame:
        """``step`` on planes that are computed once."""
        return replace(g, planes=tuple(let(p, lambda q: step(replace(g, planes=(q,) * len(g.planes))).planes[k]) for k, p in enumerate(g.planes)))

    less = lambda a, b: pointwise(lambda x, y: F.greatest(F.lit(0), x - y), a, b, mask=planes)
    return {
        "erode": lambda: least(f), "dilate": lambda: most(f), "open": lambda: then(least(f), most), "close": lambda: then(most(f), least),
        "gradient": lambda: less(most(f), least(f)), "tophat": lambda: less(f, then(least(f), most)), "blackhat": lambda: less(then(most(f), least), f),
    }[mode]()


# Values


@named("lut", "lutyuv", "lutrgb")
def lut(f: Frame, c0: str = "clipval", c1: str = "clipval", c2: str = "clipval", c3: str = "clipval", minval: int = 0, maxval: int = 255) -> Frame:
    """An expression for each plane. Variables: val, clipval, negval, minval, maxval, w, h; cut to a whole number."""
    out = []
    for text, p in zip((c0, c1, c2, c3), f.planes, strict=False):

        def value(v: Column, _: Column, text: str = text) -> Column:
            clip = limit(v, F.lit(minval), F.lit(maxval))
            x = to_column(text, {"val": v, "clipval": clip, "negval": limit(F.lit(maxval + minval) - v, F.lit(minval), F.lit(maxval)), "minval": F.lit(minval), "maxval": F.lit(maxval), "w": f.w, "h": f.h})
            return limit(F.when(F.isnan(x), 0).otherwise(limit(x, F.lit(0.0), F.lit(255.0))).cast("int"), F.lit(0), F.lit(255))

        # 256 values at most: the expression is evaluated once for each
        table = each_of(F.sequence(F.lit(0), F.lit(255)), value)
        out.append(_through(p, table))
    return replace(f, planes=tuple(out))


def _through(p: Column, table: Column) -> Column:
    return let(table, lambda t: F.transform(p, lambda v: F.get(t, v)))


@named("lut2", "tlut2")
def lut2(f: Frame, g: Frame, c0: str = "x", c1: str = "x", c2: str = "x", c3: str = "x") -> Frame:
    """An expression of x and y, the pixels of both frames, for each plane; tlut2: y is of the frame before."""
    cut = lambda x: F.when(F.isnan(x), 0).otherwise(limit(x, F.lit(0.0), F.lit(255.0))).cast("int")
    pairs = zip((c0, c1, c2, c3), f.planes, g.planes, strict=False)
    return replace(f, planes=tuple(each_of(p, lambda v, i, t=t, q=q: cut(to_column(t, {"x": v, "y": F.get(q, i)}))) for t, p, q in pairs))


@named("pseudocolor")
def pseudocolor(f: Frame, c0: str = "val", c1: str = "val", c2: str = "val", index: int = 0) -> Frame:
    """Each plane is an expression of the value of the plane ``index``."""
    return lut(replace(f, planes=(f.planes[index],) * 3), c0, c1, c2)


@named("colorchannelmixer")
def colorchannelmixer(f: Frame, **weights: float) -> Frame:
    """rr, rg .. aa: how much of the second letter's component goes into the first's; rr, gg, bb, aa are 1 by default."""
    names = "rgba"[: len(f.planes)]
    w = lambda a, b: weights.get(a + b, 1.0 if a == b else 0.0)
    return mixed(f, lambda *v: [byte(sum((v[j] * float(w(a, b)) for j, b in enumerate(names)), F.lit(0.0))) for a in names])


@named("colorlevels")
def colorlevels(f: Frame, **levels: float) -> Frame:
    """rimin, rimax, romin, romax .. of r, g, b, a, as shares of 255: input levels are stretched to output levels, cut down."""
    out = []
    for c, p in zip("rgba", f.planes, strict=False):
        low, high, o0, o1 = levels.get(f"{c}imin", 0.0), levels.get(f"{c}imax", 1.0), levels.get(f"{c}omin", 0.0), levels.get(f"{c}omax", 1.0)
        t = lambda v, low=low, high=high: F.lit(0.0) if abs(high - low) < 1e-12 else limit((v / 255.0 - low) / (high - low), F.lit(0.0), F.lit(1.0))
        out.append(each_of(p, lambda v, i, t=t, o0=o0, o1=o1: F.floor(limit((o0 + t(v) * (o1 - o0)) * 255.0, F.lit(0.0), F.lit(255.0)))))
    return replace(f, planes=tuple(out))


@named("hue")
def hue(f: Frame, h: float = 0.0, s: float = 1.0) -> Frame:
    """Chroma (planes 1 and 2) is turned by ``h`` degrees and scaled by ``s``."""
    c, d = math.cos(math.radians(h)) * s, math.sin(math.radians(h)) * s
    u, v = f.planes[1], f.planes[2]
    new_u = F.transform(u, lambda a, i: byte((a - 128) * c - (F.get(v, i) - 128) * d + 128).cast("int"))
    new_v = F.transform(v, lambda b, i: byte((F.get(u, i) - 128) * d + (b - 128) * c + 128).cast("int"))
    return replace(f, planes=(f.planes[0], new_u, new_v, *f.planes[3:]))


#: Weights of red and blue in luma.
MATRICES = {"bt709": (0.2126, 0.0722), "bt601": (0.299, 0.114), "fcc": (0.30, 0.11), "smpte240m": (0.212, 0.087), "bt2020": (0.2627, 0.0593)}


@named("colormatrix")
def colormatrix(f: Frame, src: str, dst: str) -> Frame:
    """YUV of one matrix as YUV of another, by way of RGB, limited range."""
    (r0, b0), (r1, b1) = MATRICES[src], MATRICES[dst]
    g0, g1 = 1 - r0 - b0, 1 - r1 - b1

    def new(y: Column, u: Column, v: Column, *rest: Column) -> list[Column]:
        luma, cb, cr = (y - 16) / 219.0, (u - 128) / 224.0, (v - 128) / 224.0
        red, blue = luma + 2 * (1 - r0) * cr, luma + 2 * (1 - b0) * cb
        green = (luma - r0 * red - b0 * blue) / g0
        other = r1 * red + g1 * green + b1 * blue
        return [byte(other * 219 + 16), byte((blue - other) / (2 * (1 - b1)) * 224 + 128), byte((red - other) / (2 * (1 - r1)) * 224 + 128), *rest]

    return mixed(f, new)


@named("exposure")
def exposure(f: Frame, exposure: float = 0.0, black: float = 0.0) -> Frame:
    """Stops of light, ``black`` taken off first; on shares of 255."""
    by = 2.0**exposure
    return pointwise(lambda v: byte((v / 255.0 * by - black) / abs(1 - black) * 255), f)


@named("normalize")
def normalize(f: Frame, independence: float = 1.0, strength: float = 1.0, black: tuple[int, ...] = (0, 0, 0), white: tuple[int, ...] = (255, 255, 255)) -> Frame:
    """Each component is stretched from its least and greatest value in the frame to ``black`` and ``white``; without
    independence, from those of all components."""
    rgb = f.planes[:3]
    least, most = F.least(*map(F.array_min, rgb)), F.greatest(*map(F.array_max, rgb))
    out = []
    for k, p in enumerate(rgb):
        low = independence * F.array_min(p) + (1 - independence) * least
        span = independence * F.array_max(p) + (1 - independence) * most - low
        share = lambda v, low=low, span=span: F.when(span > 0, limit((v - low) * 256.0 / F.when(span > 0, span).otherwise(1.0), F.lit(0.0), F.lit(255.0))).otherwise(0.0) / 255.0
        out.append(each_of(p, lambda v, i, k=k, share=share: byte(v * (1 - strength) + (black[k] + share(v) * (white[k] - black[k])) * strength)))
    return replace(f, planes=(*out, *f.planes[3:]))


@named("limitdiff")
def limitdiff(f: Frame, g: Frame, threshold: float = 1 / 255, elasticity: float = 2.0, planes: int = 15) -> Frame:
    """The first frame where both differ by up to ``threshold`` (a share of 255), the second from ``elasticity`` times that
    on, a ramp between."""
    t = threshold * 255
    far = t * elasticity

    def value(a: Column, b: Column) -> Column:
        d = F.abs(a - b)
        ramp = a + (b - a) * ((d - t) / (far - t) if far > t else F.lit(1.0))
        return byte(F.when(d <= t, a.cast("double")).when(d >= far, b.cast("double")).otherwise(ramp))

    return pointwise(value, f, g, mask=planes)


@named("multiply")
def multiply(f: Frame, g: Frame, scale: float = 1.0, offset: float = 0.5) -> Frame:
    """The first frame times the second, less ``offset``: as published, (a/255)(b/255) scale + offset, of 255."""
    return pointwise(lambda a, b: byte(a / 255.0 * (b / 255.0) * scale * 255 + offset * 255), f, g)


@named("mix")
def mix(*frames: Frame, weights: tuple[float, ...] | None = None, scale: float = 0.0) -> Frame:
    """A weighted sum over ``scale`` (0: the sum of the weights), halves to even."""
    w = [float(x) for x in (weights or (1.0,) * len(frames))]
    by = scale or sum(w)
    return pointwise(lambda *v: limit(F.rint(sum((x * c for x, c in zip(v, w, strict=True)), F.lit(0.0)) / by), F.lit(0), F.lit(255)), *frames)


@named("xmedian")
def xmedian(*frames: Frame, percentile: float = 0.5) -> Frame:
    """The value of a rank among all inputs."""
    rank = math.floor(percentile * (len(frames) - 1) + 0.5)
    return pointwise(lambda *v: F.get(F.array_sort(F.array(*v)), F.lit(rank)), *frames)


@named("xfade")
def xfade(f: Frame, g: Frame, progress: float | Column = 0.0) -> Frame:
    """From the first frame to the second, as far as ``progress`` (0 to 1), rounded down."""
    t = limit(_int(progress).cast("double"), F.lit(0.0), F.lit(1.0))
    return pointwise(lambda a, b: F.floor(a + t * (b - a)), f, g)


# Keys and masks


@named("maskedmerge")
def maskedmerge(base: Frame, over: Frame, mask: Frame, planes: int = 15) -> Frame:
    return pointwise(lambda b, o, m: byte(b + (o - b) * m / 255.0), base, over, mask, mask=planes)


@named("maskedclamp")
def maskedclamp(base: Frame, dark: Frame, bright: Frame, undershoot: int = 0, overshoot: int = 0, planes: int = 15) -> Frame:
    low, high = lambda d: limit(d - undershoot, F.lit(0), F.lit(255)), lambda b: limit(b + overshoot, F.lit(0), F.lit(255))
    return pointwise(lambda v, d, b: F.greatest(low(d), F.least(F.greatest(high(b), low(d)), v)), base, dark, bright, mask=planes)


@named("maskedmax")
def maskedmax(source: Frame, a: Frame, b: Frame, planes: int = 15) -> Frame:
    """Of two frames the pixel that differs more from the source; ties: the first."""
    return pointwise(lambda s, x, y: F.when(F.abs(s - y) > F.abs(s - x), y).otherwise(x), source, a, b, mask=planes)


@named("maskedmin")
def maskedmin(source: Frame, a: Frame, b: Frame, planes: int = 15) -> Frame:
    return pointwise(lambda s, x, y: F.when(F.abs(s - y) < F.abs(s - x), y).otherwise(x), source, a, b, mask=planes)


@named("maskedthreshold")
def maskedthreshold(source: Frame, reference: Frame, threshold: int = 1, mode: str = "abs", planes: int = 15) -> Frame:
    if mode == "diff":
        return pointwise(lambda s, r: F.least(s, F.greatest(F.lit(0), r - threshold)), source, reference, mask=planes)
    return pointwise(lambda s, r: F.when(F.abs(s - r) <= threshold, s).otherwise(r), source, reference, mask=planes)


@named("threshold")
def threshold(source: Frame, limits: Frame, low: Frame, high: Frame, planes: int = 15) -> Frame:
    """``high`` where the source is above ``limits``, else ``low``."""
    return pointwise(lambda s, t, a, b: F.when(s > t, b).otherwise(a), source, limits, low, high, mask=planes)


@named("premultiply")
def premultiply(f: Frame, alpha: Frame, planes: int = 15) -> Frame:
    return pointwise(lambda v, a: byte(v * a / 255.0), f, replace(alpha, planes=alpha.planes[:1]), mask=planes)


@named("unpremultiply")
def unpremultiply(f: Frame, alpha: Frame, planes: int = 15) -> Frame:
    """Where alpha is 0 the result is 0."""
    return pointwise(lambda v, a: F.when(a == 0, 0).otherwise(byte(v * 255.0 / F.greatest(a, F.lit(1)))), f, replace(alpha, planes=alpha.planes[:1]), mask=planes)


def _key(v: tuple[Column, ...], color: tuple[int, int, int], similarity: float, blend: float) -> Column:
    """0 at the colour, 1 away from it."""
    d = F.sqrt(sum((F.pow(x / 255.0 - c / 255.0, 2) for x, c in zip(v[1:3], color[1:], strict=True)), F.pow(v[0] / 255.0 - color[0] / 255.0, 2))) / math.sqrt(3)
    return F.when(d > similarity, 1.0).otherwise(0.0) if blend <= 0 else limit((d - similarity) / blend, F.lit(0.0), F.lit(1.0))


@named("colorkey")
def colorkey(f: Frame, color: tuple[int, int, int] = (0, 0, 0), similarity: float = 0.01, blend: float = 0.0) -> Frame:
    """Alpha (plane 3) is 0 near a colour, 255 away from it, cut down between."""
    rgb = f.planes[:3]
    alpha = F.transform(rgb[0], lambda v, i: F.floor(_key((v, F.get(rgb[1], i), F.get(rgb[2], i)), color, similarity, blend) * 255).cast("int"))
    return replace(f, planes=(*rgb, alpha))


@named("colorhold")
def colorhold(f: Frame, color: tuple[int, int, int] = (0, 0, 0), similarity: float = 0.01, blend: float = 0.0) -> Frame:
    """All but a colour becomes gray, the mean of the components; cut down."""

    def new(*v: Column) -> list[Column]:
        t, gray = _key(v, color, similarity, blend), (v[0] + v[1] + v[2]) / 3.0
        return [F.floor(x * (1 - t) + gray * t + 1e-9) for x in v[:3]] + list(v[3:])

    return mixed(f, new)


# Drawing


@named("drawbox")
def drawbox(f: Frame, x: int = 0, y: int = 0, width: int = 0, height: int = 0, color: tuple[int, ...] = (0, 0, 0, 255), thickness: int | None = 3, opacity: float = 1.0) -> Frame:
    """A frame of ``thickness``, or a filled box (None), inside the rectangle; sizes of 0: the frame's."""
    w, h = F.lit(width) if width else f.w, F.lit(height) if height else f.h
    inside = lambda i, j: (i >= x) & (i < w + x) & (j >= y) & (j < h + y)
    edge = lambda i, j: F.lit(True) if thickness is None else (i - x < thickness) | (j - y < thickness) | (w + x - i <= thickness) | (h + y - j <= thickness)
    paint = lambda v, k: byte(v * (1 - opacity) + color[k] * opacity)
    return replace(f, planes=tuple(draw(f.w, f.h, lambda i, j, p=p, k=k: F.when(inside(i, j) & edge(i, j), paint(at(p, f.w, f.h, i, j), k)).otherwise(at(p, f.w, f.h, i, j))) for k, p in enumerate(f.planes)))


@named("drawgrid")
def drawgrid(f: Frame, x: int = 0, y: int = 0, width: int = 8, height: int = 8, color: tuple[int, ...] = (0, 0, 0, 255), thickness: int = 1) -> Frame:
    line = lambda i, j: (F.pmod(i - x, F.lit(width)) < thickness) | (F.pmod(j - y, F.lit(height)) < thickness)
    return replace(f, planes=tuple(draw(f.w, f.h, lambda i, j, p=p, k=k: F.when(line(i, j), color[k]).otherwise(at(p, f.w, f.h, i, j))) for k, p in enumerate(f.planes)))


# Several frames


@named("hstack")
def hstack(*frames: Frame) -> Frame:
    """Side by side; the first one's height counts."""
    a = frames[0]
    if len(frames) == 1:
        return a
    b = frames[1]
    planes = tuple(draw(a.w + b.w, a.h, lambda x, y, p=p, q=q: F.when(x < a.w, at(p, a.w, a.h, x, y)).otherwise(at(q, b.w, b.h, x - a.w, y))) for p, q in zip(a.planes, b.planes, strict=False))
    return hstack(Frame(a.w + b.w, a.h, planes), *frames[2:])


@named("vstack")
def vstack(*frames: Frame) -> Frame:
    """Above one another: planes are joined, the first one's width counts."""
    a = frames[0]
    return Frame(a.w, sum((f.h for f in frames[1:]), a.h), tuple(F.concat(*[f.planes[k] for f in frames]) for k in range(min(len(f.planes) for f in frames))))


@named("xstack")
def xstack(*frames: Frame, layout: tuple[tuple[int, int], ...], width: int, height: int, fill: tuple[int, ...] = (0, 0, 0, 255)) -> Frame:
    """Each frame at its (x, y) of ``layout``; later ones cover earlier ones."""

    def plane(k: int) -> Column:
        def pixel(x: Column, y: Column) -> Column:
            out = F.lit(fill[k])
            for f, (a, b) in zip(frames, layout, strict=True):
                out = F.when((x >= a) & (x < f.w + a) & (y >= b) & (y < f.h + b), at(f.planes[k], f.w, f.h, x - a, y - b)).otherwise(out)
            return out

        return draw(F.lit(width), F.lit(height), pixel)

    return Frame(F.lit(width), F.lit(height), tuple(plane(k) for k in range(min(len(f.planes) for f in frames))))


@named("overlay")
def overlay(f: Frame, g: Frame, x: int = 0, y: int = 0) -> Frame:
    """The second frame over the first at (x, y); its plane 3, if there is one, is how opaque it is."""
    alpha = g.planes[3] if len(g.planes) > 3 else None

    def plane(p: Column, q: Column) -> Column:
        def pixel(i: Column, j: Column) -> Column:
            under, over = at(p, f.w, f.h, i, j), at(q, g.w, g.h, i - x, j - y)
            if alpha is not None:
                a = at(alpha, g.w, g.h, i - x, j - y)
                over = byte((over * a + under * (255 - a)) / 255.0)
            return F.when((i >= x) & (i < g.w + x) & (j >= y) & (j < g.h + y), over).otherwise(under)

        return draw(f.w, f.h, pixel)

    return replace(f, planes=tuple(plane(p, q) for p, q in zip(f.planes[:3], g.planes, strict=False)) + f.planes[3:])


@named("framepack")
def framepack(f: Frame, g: Frame, format: str = "sbs") -> Frame:
    """Left and right eye in one frame: side by side, top and bottom, or alternating lines or columns."""
    if format == "sbs":
        return hstack(f, g)
    if format == "tab":
        return vstack(f, g)
    lines = {"lines": True, "columns": False}[format]
    w, h = (f.w, 2 * f.h) if lines else (2 * f.w, f.h)
    turn = lambda x, y: y % 2 == 0 if lines else x % 2 == 0
    place = lambda x, y: (x, F.floor(y / 2)) if lines else (F.floor(x / 2), y)
    return Frame(w, h, tuple(draw(w, h, lambda x, y, p=p, q=q: F.when(turn(x, y), at(p, f.w, f.h, *place(x, y))).otherwise(at(q, g.w, g.h, *place(x, y)))) for p, q in zip(f.planes, g.planes, strict=True)))


@named("weave", "doubleweave")
def weave(f: Frame, g: Frame, first_field: str = "top") -> Frame:
    """Two fields become a frame of twice the height; the first one has the even rows, or the odd ones (``bottom``)."""
    a, b = (f, g) if first_field == "top" else (g, f)
    return framepack(a, b, "lines")


@named("displace")
def displace(f: Frame, mx: Frame, my: Frame, edge: str = "smear") -> Frame:
    """Each pixel comes from as far right and down as the maps say above 128; edge: smear, wrap, mirror or blank (0)."""

    def folded(c: Column, size: Column) -> Column:
        if edge == "wrap":
            return F.pmod(c, size)
        if edge == "mirror":
            m = F.pmod(c, 2 * size)
            return F.when(m < size, m).otherwise(2 * size - 1 - m)
        return c

    def plane(k: int) -> Column:
        pick = lambda m, x, y: at(m.planes[min(k, len(m.planes) - 1)], f.w, f.h, x, y) - 128

        def pixel(x: Column, y: Column) -> Column:
            u, v = x + pick(mx, x, y), y + pick(my, x, y)
            found = at(f.planes[k], f.w, f.h, folded(u, f.w), folded(v, f.h))
            return F.when((u >= 0) & (u < f.w) & (v >= 0) & (v < f.h), found).otherwise(0) if edge == "blank" else found

        return draw(f.w, f.h, pixel)

    return replace(f, planes=tuple(plane(k) for k in range(len(f.planes))))


@named("remap")
def remap(f: Frame, mx: Frame, my: Frame, fill: tuple[int, ...] = (0, 0, 0, 255)) -> Frame:
    """Each pixel comes from the place that the maps hold; places outside give ``fill``."""

    def plane(k: int, p: Column) -> Column:
        def pixel(x: Column, y: Column) -> Column:
            u, v = at(mx.planes[0], f.w, f.h, x, y), at(my.planes[0], f.w, f.h, x, y)
            return F.when((u < f.w) & (v < f.h), at(p, f.w, f.h, u, v)).otherwise(fill[k])

        return draw(f.w, f.h, pixel)

    return replace(f, planes=tuple(plane(k, p) for k, p in enumerate(f.planes)))


# DataFrames


def frame(df: DataFrame, prefix: str = "") -> Frame:
    """The frame that a DataFrame's columns ``w``, ``h``, ``p0`` .. hold."""
    planes = [c for c in (f"{prefix}p{k}" for k in range(4)) if c in df.columns]
    # bound to this DataFrame: by name alone, what lambdas use could be taken for the new columns of the same names
    return Frame(df[f"{prefix}w"], df[f"{prefix}h"], tuple(df[c] for c in planes))


def _written_back(df: DataFrame, out: Frame) -> DataFrame:
    new = {"w": out.w.cast("int"), "h": out.h.cast("int")} | {f"p{k}": p for k, p in enumerate(out.planes)}
    return df.withColumns(new).drop(*[f"p{k}" for k in range(len(out.planes), 4)])


def apply(frames: DataFrame, name: str, **options) -> DataFrame:
    """A filter of one input on every frame; all other columns stay."""
    return _written_back(frames, FILTERS[name](frame(frames), **options))


def apply_joined(name: str, keys: list[str], *inputs: DataFrame, **options) -> DataFrame:
    """A filter of several inputs on frames that agree in ``keys``; other columns come from the first input."""
    out = inputs[0]
    for k, other in enumerate(inputs[1:], 1):
        own = other.select(*keys, *[F.col(c).alias(f"_{k}{c}") for c in ("w", "h", "p0", "p1", "p2", "p3") if c in other.columns])
        out = out.join(own, keys)
    frames = [frame(out), *[frame(out, f"_{k}") for k in range(1, len(inputs))]]
    done = _written_back(out, FILTERS[name](*frames, **options))
    return done.select(*[c for c in done.columns if not (c[:1] == "_" and c[1:2].isdigit())])


def untiled(frames: DataFrame, columns: int, rows: int) -> DataFrame:
    """A row for each cell of the grid; ``cell`` counts from 0, row by row."""
    return apply(frames.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1)))), "untile", k=F.col("cell"), columns=columns, rows=rows)


def separatefields(frames: DataFrame) -> DataFrame:
    """Two rows for each frame: the even rows (``field`` 0), and the odd ones (1)."""
    both = frames.withColumn("field", F.explode(F.array(F.lit(0), F.lit(1))))
    f = frame(both)
    return _written_back(both, gather(f, f.w, F.floor((f.h + 1 - F.col("field")) / 2), lambda x, y: (x, 2 * y + F.col("field"))))


# More of neighbourhoods, tables and colours


@named("cas")
def cas(f: Frame, strength: float = 0.0, planes: int = 7) -> Frame:
    """Sharpens by the four neighbours, less where the local range is near its limits."""
    peak = -0.125 * (1 - strength) - 0.2 * strength

    def value(v: Callable[[int, int], Column]) -> Column:
        c, n, s, w, e = (v(*o) / 255.0 for o in ((0, 0), (0, -1), (0, 1), (-1, 0), (1, 0)))
        low, high = F.least(n, s, w, e, c), F.greatest(n, s, w, e, c)
        amp = F.when(high > 0, F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(low, 1 - high) / F.when(high > 0, high).otherwise(1.0))))).otherwise(0.0)
        k = amp * peak
        return byte(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((n + s + w + e) * k + c) / (4 * k + 1))) * 255)

    return stencil(f, value, planes)


@named("removegrain")
def removegrain(f: Frame, m0: int = 0, m1: int | None = None, m2: int | None = None, m3: int | None = None) -> Frame:
    """Mode k from 1 to 4: the pixel is held between the k-th least and the k-th greatest of its neighbours; 0 leaves a plane."""
    out = f
    for k, mode in enumerate((m0, m0 if m1 is None else m1, m0 if m2 is None else m2, m0 if m3 is None else m3)[: len(f.planes)]):
        if not 0 <= mode <= 4:
            raise ValueError("modes 0 to 4")
        if mode:
            around = lambda v: F.array_sort(F.array(*[v(*o) for o in AROUND]))
            out = stencil(out, lambda v, m=mode: let(around(v), lambda a: limit(v(0, 0), F.get(a, F.lit(m - 1)), F.get(a, F.lit(8 - m)))), 1 << k)
    return out


@named("varblur")
def varblur(f: Frame, control: Frame, min_r: int = 0, max_r: int = 8, planes: int = 15) -> Frame:
    """The mean of a box, rounded down, whose radius goes from ``min_r`` to ``max_r`` as the control frame does from 0 to 255."""

    def pixel(p: Column, c: Column) -> Callable[[Column, Column], Column]:
        def value(x: Column, y: Column) -> Column:
            r = F.floor(min_r + (max_r - min_r) * at(c, f.w, f.h, x, y) / 255.0 + 0.5).cast("int")
            side = 2 * r + 1
            total = F.aggregate(F.sequence(F.lit(0), side * side - 1), F.lit(0), lambda a, k: a + at(p, f.w, f.h, x + k % side - r, y + F.floor(k / side).cast("int") - r))
            return F.floor(total / (side * side))

        return value

    return replace(f, planes=tuple(draw(f.w, f.h, pixel(p, control.planes[min(k, len(control.planes) - 1)])) if planes >> k & 1 else p for k, p in enumerate(f.planes)))


@named("vignette")
def vignette(f: Frame, angle: float = math.pi / 5, x0: float | None = None, y0: float | None = None, mode: str = "forward", aspect: float = 1.0) -> Frame:
    """Times the fourth power of a cosine that falls off from the middle, cut down; backward: over it, up to 255."""
    cx, cy = f.w / 2 if x0 is None else F.lit(x0), f.h / 2 if y0 is None else F.lit(y0)

    def factor(x: Column, y: Column) -> Column:
        theta = angle * F.sqrt(F.pow(x - cx, 2) + F.pow((y - cy) * aspect, 2)) / F.sqrt(cx * cx + cy * cy)
        return F.when(theta < math.pi / 2, F.pow(F.cos(theta), 4)).otherwise(0.0)

    def pixel(p: Column) -> Callable[[Column, Column], Column]:
        if mode == "forward":
            return lambda x, y: F.floor(at(p, f.w, f.h, x, y) * factor(x, y))
        return lambda x, y: F.when(factor(x, y) == 0, F.when(at(p, f.w, f.h, x, y) == 0, 0).otherwise(255)).otherwise(F.floor(F.least(F.lit(255.0), at(p, f.w, f.h, x, y) / F.when(factor(x, y) == 0, 1.0).otherwise(factor(x, y)))))

    return f.each(lambda p: draw(f.w, f.h, pixel(p)))


@named("delogo")
def delogo(f: Frame, x: int, y: int, w: int, h: int) -> Frame:
    """A rectangle is filled from the pixels around it: across and down, each the surer the farther the other border is; cut down."""

    def pixel(p: Column) -> Callable[[Column, Column], Column]:
        def value(i: Column, j: Column) -> Column:
            left, right, top, bottom = i - (x - 1), (x + w) - i, j - (y - 1), (y + h) - j
            across = (at(p, f.w, f.h, F.lit(x - 1), j) * right + at(p, f.w, f.h, F.lit(x + w), j) * left) / (w + 1)
            down = (at(p, f.w, f.h, i, F.lit(y - 1)) * bottom + at(p, f.w, f.h, i, F.lit(y + h)) * top) / (h + 1)
            filled = F.floor((across * top * bottom + down * left * right) / (top * bottom + left * right) + 1e-9)
            return F.when((i >= x) & (i < x + w) & (j >= y) & (j < y + h), filled).otherwise(at(p, f.w, f.h, i, j))

        return value

    return f.each(lambda p: draw(f.w, f.h, pixel(p)))


@named("noise")
def noise(f: Frame, strength: int = 10, seed: int = 0, n: int | Column = 0) -> Frame:
    """Even noise of up to ``strength`` either way, by hashes of the place, the frame's number and the seed."""
    draw_ = lambda k: lambda v, i: limit(v + F.pmod(F.xxhash64(i, F.lit(k), _int(n), F.lit(seed)), F.lit(2 * strength + 1)).cast("int") - strength, F.lit(0), F.lit(255))
    return replace(f, planes=tuple(each_of(p, draw_(k)) for k, p in enumerate(f.planes)))


@named("lut1d")
def lut1d(f: Frame, table: tuple[tuple[float, float, float], ...], interp: str = "linear") -> Frame:
    """Each component by its own column of a table from 0 to 1, nearest or linear; cut down."""
    n = len(table)
    out = []
    for c, p in enumerate(f.planes[:3]):
        values = []
        for v in range(256):
            s = v / 255 * (n - 1)
            k = min(int(s), n - 2) if n > 1 else 0
            x = table[min(n - 1, math.floor(s + 0.5))][c] if interp == "nearest" or n < 2 else table[k][c] + (s - k) * (table[k + 1][c] - table[k][c])
            values.append(F.lit(max(0, min(255, math.floor(x * 255 + 1e-6)))))
        out.append(_through(p, F.array(*values)))
    return replace(f, planes=(*out, *f.planes[3:]))


@named("lut3d")
def lut3d(f: Frame, table: tuple[tuple[float, float, float], ...], size: int, interp: str = "trilinear") -> Frame:
    """A cube of colours, red the fastest, of values from 0 to 1: the nearest entry, or between the eight around."""
    flat = [F.array(*[F.lit(float(row[c])) for row in table]) for c in range(3)]

    def new(r: Column, g: Column, b: Column, *rest: Column) -> list[Column]:
        s = [x / 255.0 * (size - 1) for x in (r, g, b)]
        if interp == "nearest":
            k = [F.floor(x + 0.5) for x in s]
            return [byte(F.get(t, (k[0] + size * k[1] + size * size * k[2]).cast("int")) * 255) for t in flat] + list(rest)
        low = [F.least(F.floor(x), F.lit(size - 2)) for x in s]
        frac = [x - a for x, a in zip(s, low, strict=True)]

        def mix(t: Column) -> Column:
            total = F.lit(0.0)
            for corner in range(8):
                bits = [corner >> k & 1 for k in range(3)]
                place = sum(((a + d) * size**k for k, (a, d) in enumerate(zip(low, bits, strict=True))), F.lit(0))
                weight = F.lit(1.0)
                for d, x in zip(bits, frac, strict=True):
                    weight = weight * (x if d else 1 - x)
                total = total + F.get(t, place.cast("int")) * weight
            return total

        return [byte(mix(t) * 255) for t in flat] + list(rest)

    return mixed(f, new)


@named("haldclut")
def haldclut(f: Frame, clut: Frame, level: int) -> Frame:
    """As ``lut3d``, the cube being the second frame's pixels in order; the nearest entry."""
    size = level * level

    def component(k: int) -> Column:
        index = lambda v: F.floor(v / 255.0 * (size - 1) + 0.5)
        g, b = f.planes[1], f.planes[2]
        return each_of(f.planes[0], lambda r, i: F.get(clut.planes[k], (index(r) + size * index(F.get(g, i)) + size * size * index(F.get(b, i))).cast("int")))

    return replace(f, planes=(*[component(k) for k in range(3)], *f.planes[3:]))


@named("paletteuse")
def paletteuse(f: Frame, palette: tuple[tuple[int, int, int], ...]) -> Frame:
    """Each pixel becomes the nearest colour of a list, ties the earlier; without dithering."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip("rgb", e, strict=True)]) for k, e in enumerate(palette)])

    def new(r: Column, g: Column, b: Column, *rest: Column) -> list[Column]:
        far = lambda e: F.pow(e["r"] - r, 2) + F.pow(e["g"] - g, 2) + F.pow(e["b"] - b, 2)
        best = F.array_min(F.transform(entries, lambda e: F.struct(far(e).alias("d"), e["k"].alias("k"), e["r"].alias("r"), e["g"].alias("g"), e["b"].alias("b"))))
        return [best["r"], best["g"], best["b"], *rest]

    return mixed(f, new)
