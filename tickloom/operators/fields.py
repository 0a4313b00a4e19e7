"""Fields of interlaced frames: apart, together, and in the patterns of film transfer. Frames of a stream (``by``) are numbered by ``n`` from 0 and
have w, h and planes as in ``pixels``. A frame's top field is its even rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pixels
from .pixels import Frame, at, draw

PLANES = ("p0", "p1", "p2", "p3")


def _planes(frames: DataFrame) -> list[str]:
    return [c for c in PLANES if c in frames.columns]


def _shifted(frames: DataFrame, by: str, by_frames: int, prefix: str) -> DataFrame:
    """Adds the planes of the frame so many places later (before: negative), the same frame's at the ends."""
    w = Window.partitionBy(by).orderBy("n")
    move = (lambda c: F.lead(c, by_frames)) if by_frames > 0 else (lambda c: F.lag(c, -by_frames))
    return frames.withColumns({f"{prefix}{c}": F.coalesce(move(c).over(w), F.col(c)) for c in _planes(frames)})


def mixed_rows(frames: DataFrame, even: str, odd: str) -> DataFrame:
    """Even rows from the planes with one prefix, odd rows from those with another."""
    w, h = frames["w"], frames["h"]
    own = _planes(frames)
    new = {f"_new{c}": draw(w, h, functools.partial(lambda x, y, a, b: F.when(y % 2 == 0, at(a, w, h, x, y)).otherwise(at(b, w, h, x, y)), a=frames[f"{even}{c}"], b=frames[f"{odd}{c}"])) for c in own}
    out = frames.withColumns(new)
    return out.select(*[F.col(f"_new{c}").alias(c) if c in own else F.col(c) for c in frames.columns if not c.startswith("_")])


def weave(fields: DataFrame, by: str, first_field: str = "top", double: bool = False) -> DataFrame:
    """Each two fields become a frame; ``double``: each field with the next one. A field without a partner goes."""
    w = Window.partitionBy(by).orderBy("n")
    own = _planes(fields)
    paired = fields.withColumns({f"_b{c}": F.lead(c).over(w) for c in own}).filter(f"_b{own[0]} is not null")
    if not double:
        paired = paired.filter("n % 2 = 0").withColumn("n", F.floor(F.col("n") / 2))
    a = Frame(paired["w"], paired["h"], tuple(paired[c] for c in own))
    b = Frame(paired["w"], paired["h"], tuple(paired[f"_b{c}"] for c in own))
    # of two fields the earlier one is first; when each is woven with the next, parities take turns
    straight, crossed = pixels.weave(a, b, first_field), pixels.weave(b, a, first_field)
    pick = lambda k: F.when(F.col("n") % 2 == 0, straight.planes[k]).otherwise(crossed.planes[k]) if double else straight.planes[k]
    new = paired.withColumns({f"_new{c}": pick(k) for k, c in enumerate(own)}).withColumn("_h", 2 * F.col("h"))
    return new.select(*[F.col(f"_new{c}").alias(c) if c in own else F.col("_h").alias("h") if c == "h" else F.col(c) for c in fields.columns])


def interlace(frames: DataFrame, by: str, scan: str = "tff", lowpass: bool = True) -> DataFrame:
    """Each two frames become one: the first one's rows of one parity, the second one's of the other. lowpass: rows are smoothed by 1, 2, 1
    first, rounded down."""
    own = frames
    if lowpass:
        w, h = frames["w"], frames["h"]
        smooth = lambda p: draw(w, h, lambda x, y: F.floor((at(p, w, h, x, y - 1) + 2 * at(p, w, h, x, y) + at(p, w, h, x, y + 1)) / 4))
        made = frames.withColumns({f"_s{c}": smooth(frames[c]) for c in _planes(frames)})
        own = made.select(*[F.col(f"_s{c}").alias(c) if c in PLANES else F.col(c) for c in frames.columns])
    w = Window.partitionBy(by).orderBy("n")
    paired = own.withColumns({f"_b{c}": F.lead(c).over(w) for c in _planes(own)}).filter(f"n % 2 = 0 and _b{_planes(own)[0]} is not null").withColumn("n", F.floor(F.col("n") / 2))
    return mixed_rows(paired, "", "_b") if scan == "tff" else mixed_rows(paired, "_b", "")


def fieldorder(frames: DataFrame, order: str = "bff") -> DataFrame:
    """Rows move up (bff) or down (tff) by one; the last one, or the first, stays."""
    move = 1 if order == "bff" else -1
    f = pixels.frame(frames)
    return pixels._written_back(frames, pixels.gather(f, f.w, f.h, lambda x, y: (x, y + move)))


def tinterlace(frames: DataFrame, by: str, mode: str = "merge") -> DataFrame:
    """merge: two frames woven to one of twice the height. drop_even, drop_odd: the others stay, of frames counted from 1. pad: the frames' rows
    and black ones in turns, twice the height. interleave_top, interleave_bottom: as ``interlace`` without smoothing. interlacex2: each frame
    with the next, at twice the rate. mergex2: each frame woven with the next, in turns."""
    if mode in ("drop_even", "drop_odd"):
        kept = frames.filter(f"n % 2 = {0 if mode == 'drop_even' else 1}")
        return kept.withColumn("n", F.floor(F.col("n") / 2))
    if mode in ("interleave_top", "interleave_bottom"):
        return interlace(frames, by, "tff" if mode == "interleave_top" else "bff", False)
    if mode in ("merge", "mergex2"):
        return weave(frames, by, "top", mode == "mergex2")
    if mode == "pad":
        f = pixels.frame(frames)
        black = tuple(draw(f.w, f.h, lambda x, y: F.lit(0)) for _ in f.planes)
        top, bottom = pixels.weave(f, Frame(f.w, f.h, black)), pixels.weave(Frame(f.w, f.h, black), f)
        planes = tuple(F.when(F.col("n") % 2 == 0, a).otherwise(b) for a, b in zip(top.planes, bottom.planes, strict=True))
        return pixels._written_back(frames, Frame(f.w, 2 * f.h, planes))
    if mode == "interlacex2":
        w = Window.partitionBy(by).orderBy("n")
        nxt = frames.withColumns({f"_b{c}": F.lead(c).over(w) for c in _planes(frames)})
        both = mixed_rows(nxt.filter(f"_b{_planes(frames)[0]} is not null"), "", "_b").withColumn("n", 2 * F.col("n") + 1)
        return frames.withColumn("n", 2 * F.col("n")).unionByName(both.select(*frames.columns))
    raise ValueError(f"no mode {mode}")


def _pattern(pattern: str) -> list[tuple[int, int]]:
    """For each output frame of a period: which input frames its first and its second field come from."""
    fields = [k for k, n in enumerate(map(int, pattern)) for _ in range(n)]
    if len(fields) % 2:
        fields += [k + len(pattern) for k in fields]
    return list(zip(fields[::2], fields[1::2], strict=True))


def telecine(frames: DataFrame, by: str, pattern: str = "23", first_field: str = "top") -> DataFrame:
    """Each frame is held for as many fields as its digit says, and two fields in turn make an output frame. An incomplete period at the end gives
    those frames whose fields are there."""
    table = _pattern(pattern)
    period = 1 + max(b for _, b in table)
    size = period if period % len(pattern) == 0 else len(pattern) * -(-period // len(pattern))
    rows = F.broadcast(frames.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(table)], "_k int, _first int, _second int"))
    keyed = frames.withColumn("_g", F.floor(F.col("n") / size)).withColumn("_i", F.col("n") % size)
    one = keyed.join(rows, F.col("_i") == F.col("_first")).drop("_i", "_first", "_second")
    two = keyed.join(rows, F.col("_i") == F.col("_second")).select(by, "_g", "_k", *[F.col(c).alias(f"_b{c}") for c in _planes(frames)])
    both = one.join(two, [by, "_g", "_k"]).withColumn("n", F.col("_g") * len(table) + F.col("_k"))
    out = mixed_rows(both, "", "_b") if first_field == "top" else mixed_rows(both, "_b", "")
    return out.select(*frames.columns)


def detelecine(frames: DataFrame, by: str, pattern: str = "23", first_field: str = "top") -> DataFrame:
    """The frames that ``telecine`` was given: each from the first output frame that holds a field of it, and another one that holds the other."""
    table = _pattern(pattern)
    size = 1 + max(b for _, b in table)
    where: dict[int, tuple[int, int]] = {}
    for frame in range(size):
        first = next((k for k, (a, _) in enumerate(table) if a == frame), None)
        second = next((k for k, (_, b) in enumerate(table) if b == frame), None)
        if first is not None and second is not None:
            where[frame] = (first, second)
    rows = F.broadcast(frames.sparkSession.createDataFrame([(f, a, b) for f, (a, b) in where.items()], "_f int, _first int, _second int"))
    keyed = frames.withColumn("_g", F.floor(F.col("n") / len(table))).withColumn("_i", F.col("n") % len(table))
    one = keyed.join(rows, F.col("_i") == F.col("_first")).drop("_i", "_first", "_second")
    two = keyed.join(rows, F.col("_i") == F.col("_second")).select(by, "_g", "_f", *[F.col(c).alias(f"_b{c}") for c in _planes(frames)])
    both = one.join(two, [by, "_g", "_f"]).withColumn("n", F.col("_g") * size + F.col("_f"))
    out = mixed_rows(both, "", "_b") if first_field == "top" else mixed_rows(both, "_b", "")
    return out.select(*frames.columns)


def repeatfields(frames: DataFrame, by: str, repeat: Column) -> DataFrame:
    """Frames are shown as often as their flag asks for: once, and ``repeat`` times more."""
    shown = frames.withColumn("_r", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), repeat.cast("int")))))
    return shown.withColumn("n", (F.row_number().over(Window.partitionBy(by).orderBy("n", "_r")) - 1).cast("long")).drop("_r")


def phase(frames: DataFrame, by: str, mode: str = "t") -> DataFrame:
    """One field comes a frame late: t takes the bottom field from the frame before, b the top field, p neither."""
    if mode == "p":
        return frames
    both = _shifted(frames, by, -1, "_b")
    return mixed_rows(both, "", "_b") if mode == "t" else mixed_rows(both, "_b", "")


def fieldhint(frames: DataFrame, by: str, hints: DataFrame) -> DataFrame:
    """Top and bottom field of each frame from those that ``hints`` (n, top, bottom) names; frames without a hint go."""
    tops = frames.select(by, F.col("n").alias("top"), *[F.col(c).alias(f"_a{c}") for c in _planes(frames)])
    bottoms = frames.select(by, F.col("n").alias("bottom"), *[F.col(c).alias(f"_b{c}") for c in _planes(frames)])
    both = frames.join(hints, "n").join(tops, [by, "top"]).join(bottoms, [by, "bottom"])
    return mixed_rows(both, "_a", "_b").select(*frames.columns)


def deinterlaced(frames: DataFrame, by: str, parity: str = "top", temporal: bool = True) -> DataFrame:
    """Rows of the other parity anew: the mean of the rows above and below, held within what the same row shows in the frames before and after
    (``temporal``) widened by how much these differ from it."""
    both = _shifted(_shifted(frames, by, -1, "_p"), by, 1, "_q")
    w, h = both["w"], both["h"]
    other = 1 if parity == "top" else 0

    def plane(c: str) -> Column:
        p, before, after = both[c], both[f"_p{c}"], both[f"_q{c}"]

        def pixel(x: Column, y: Column) -> Column:
            up, down = at(p, w, h, x, F.when(y == 0, y + 1).otherwise(y - 1)), at(p, w, h, x, F.when(y == h - 1, y - 1).otherwise(y + 1))
            space = F.floor((up + down) / 2)
            if temporal:
                a, b = at(before, w, h, x, y), at(after, w, h, x, y)
                middle, reach = F.floor((a + b) / 2), F.floor(F.abs(a - b) / 2)
                space = F.greatest(middle - reach, F.least(middle + reach, space))
            return F.when(y % 2 == other, space).otherwise(at(p, w, h, x, y))

        return draw(w, h, pixel)

    own = _planes(frames)
    made = both.withColumns({f"_new{c}": plane(c) for c in own})
    return made.select(*[F.col(f"_new{c}").alias(c) if c in own else F.col(c) for c in frames.columns])


def combing(frames: DataFrame, by: str) -> DataFrame:
    """(by, n, even_older, odd_older, own): how much rows differ from their neighbours when the even, or the odd, rows come from the frame
    before, or none."""
    both = _shifted(frames, by, -1, "_b")
    w, h = both["w"], both["h"]

    def score(even: Column, odd: Column) -> Column:
        p = lambda x, y: F.when(F.pmod(y, F.lit(2)) == 0, at(even, w, h, x, y)).otherwise(at(odd, w, h, x, y))
        # the first and last row have one neighbour only
        d = draw(w, h, lambda x, y: F.when((y == 0) | (y == h - 1), 0).otherwise(F.abs(2 * p(x, y) - p(x, y - 1) - p(x, y + 1))))
        return F.aggregate(d, F.lit(0).cast("long"), lambda a, v: a + v)

    return both.select(by, "n", score(both["_bp0"], both["p0"]).alias("even_older"), score(both["p0"], both["_bp0"]).alias("odd_older"), score(both["p0"], both["p0"]).alias("own"))


def idet(frames: DataFrame, by: str, interlaced: float = 1.04, progressive: float = 1.5) -> DataFrame:
    """(by, n, kind): tff where older even rows comb more than older odd ones, bff where less; else progressive, where mixtures comb more than the
    frame itself, or undetermined."""
    s = combing(frames, by)
    even, odd, own = F.col("even_older"), F.col("odd_older"), F.col("own")
    kind = F.when(even > interlaced * odd, "tff").when(odd > interlaced * even, "bff").when(odd > progressive * own, "progressive").otherwise("undetermined")
    return s.select(by, "n", kind.alias("kind"))
