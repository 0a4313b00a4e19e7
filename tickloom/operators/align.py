"""Alignment of streams: frame-sync and as-of joins with end-of-stream policies, lockstep and interval joins."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, previous, running, tie


def asof(main: DataFrame, other: DataFrame, by: str, mode: str = "backward", eof: str = "repeat", bucket: int | None = None) -> DataFrame:
    """(by, pts, v, other_pts, other_v): for each record of ``main`` the newest of ``other`` at or before it.

    mode ``nearest``: the nearer of that and the next one, ties keep the earlier. eof: what holds once ``other`` has
    ended, after its last pts: ``repeat`` its last record, ``pass`` nulls, ``endall`` main ends as well.
    Both sides meet in one sort for each stream (and one backwards, for ``nearest``): no record is paired with more than
    it needs, and a running value replaces a search. bucket: see ``order``.
    """
    if mode not in ("backward", "nearest"):
        raise ValueError("mode is backward or nearest")
    if eof not in ("repeat", "pass", "endall"):
        raise ValueError("eof is repeat, pass or endall")
    ties = tie(main) if tie(other) else []
    none = F.lit(None).cast("struct<pts:bigint,v:double>")
    both = main.select(by, "pts", "v", *ties, F.lit(1).alias("_main"), none.alias("_o")).unionAll(
        other.select(by, "pts", F.lit(None).cast("double"), *ties, F.lit(0), F.struct(F.col("pts").cast("long").alias("pts"), F.col("v").cast("double").alias("v")))
    )
    both = running(both, by, {"_before": ("last", F.col("_o"))}, bucket, ("_main",))
    if mode == "nearest":
        both = running(both, by, {"_after": ("last", F.col("_o"))}, bucket, ("_main",), descending=True)
        nearer = F.col("_before").isNull() | (F.col("_after").isNotNull() & ((F.col("_after.pts") - F.col("pts")) < (F.col("pts") - F.col("_before.pts"))))
        both = both.withColumn("_before", F.when(nearer, F.col("_after")).otherwise(F.col("_before")))
    out = both.filter("_main = 1")
    if eof != "repeat":
        out = out.join(other.groupBy(by).agg(F.max("pts").alias("_end")), by, "left")
    if eof == "pass":
        out = out.withColumn("_before", F.when(F.col("pts") <= F.col("_end"), F.col("_before")))
    elif eof == "endall":
        out = out.filter(F.col("pts") <= F.col("_end"))
    return out.select(by, "pts", "v", F.col("_before.pts").alias("other_pts"), F.col("_before.v").alias("other_v"))


def framesync(inputs: list[DataFrame], by: str, uniform: bool = False, eof: str = "repeat", shortest: bool = False, repeatlast: bool = True, bucket: int | None = None) -> DataFrame:
    """(by, pts, v0, v1 ..): records of several inputs that hold at the same time.

    dual (the default): events are the times of input 0, and once it has ended, those of the others; before its first
    record another input is null. uniform: events are the times of all inputs, from when all of them have begun.
    eof ``repeat``: an ended input's last record holds on. ``endall``, or ``shortest``: everything ends after the last
    record of the first input to end. ``pass``, or ``repeatlast`` off: everything ends with input 0, others become null.
    An input without records in a stream gives nothing there (uniform, shortest) or nulls.
    """
    stop = shortest or eof == "endall"
    null = not stop and (eof == "pass" or not repeatlast)
    names = [f"v{k}" for k in range(len(inputs))]
    rows = functools.reduce(DataFrame.unionAll, [d.select(by, "pts", F.lit(k).alias("_k"), F.struct(F.col("v").cast("double").alias("v"), *(tie(d) and [F.col("arrival").cast("long").alias("a")] or [F.lit(0).cast("long").alias("a")])).alias("_r")) for k, d in enumerate(inputs)])
    newest = [F.max_by(F.when(F.col("_k") == k, F.struct("_r")), F.when(F.col("_k") == k, F.col("_r.a"))).alias(f"_{k}") for k in range(len(inputs))]
    wide = rows.groupBy(by, "pts").agg(*newest)
    ends = rows.groupBy(by).agg(*[F.max(F.when(F.col("_k") == k, F.col("pts"))).alias(f"_e{k}") for k in range(len(inputs))])
    wide = running(wide.withColumn("_at0", F.col("_0").isNotNull()), by, {f"_l{k}": ("last", F.col(f"_{k}")) for k in range(len(inputs))}, bucket).join(ends, by)
    all_ends = [F.col(f"_e{k}") for k in range(len(inputs))]
    event = functools.reduce(Column.__and__, [F.col(f"_l{k}").isNotNull() for k in range(len(inputs))]) if uniform else F.col("_l0").isNotNull() & (F.col("_at0") | (F.col("pts") > F.col("_e0")))
    if stop:
        known = functools.reduce(Column.__and__, [e.isNotNull() for e in all_ends])
        event = event & known & (F.col("pts") <= F.least(*all_ends)) if len(inputs) > 1 else event
    elif null:
        event = event & (F.col("pts") <= F.col("_e0"))
    value = lambda k: F.when(F.col("pts") <= F.col(f"_e{k}"), F.col(f"_l{k}._r.v")) if null and k else F.col(f"_l{k}._r.v")
    return wide.filter(event).select(by, "pts", *[value(k).alias(names[k]) for k in range(len(inputs))])


def common_base(*bases: tuple[int, int], most: int = 1_000_000) -> tuple[int, int]:
    """The time base that all of several ones are multiples of; its denominator is ``most`` at most."""
    num = functools.reduce(math.gcd, [n * (math.lcm(*[d for _, d in bases]) // d) for n, d in bases])
    den = math.lcm(*[d for _, d in bases])
    g = math.gcd(num, den)
    return (num // g, den // g) if den // g <= most else (1, most)


def lockstep(a: DataFrame, b: DataFrame, by: str, bucket: int | None = None) -> DataFrame:
    """(by, n, a, b): the n-th record of the one with the n-th of the other, until either ends."""
    x = numbered(a, by, "n", bucket).select(by, "n", F.col("v").alias("a"))
    return x.join(numbered(b, by, "n", bucket).select(by, "n", F.col("v").alias("b")), [by, "n"])


def intervals(events: DataFrame, cues: DataFrame, width: int, by: str | None = None, wide: int = 64, parts: int | None = None) -> DataFrame:
    """(by, pts, v, cue): cues with start <= pts < end, of the same stream if ``by`` is given.

    A cue is dealt to each bucket that it touches and meets the events of that bucket by equality: buckets of ``width``
    or, for cues longer than ``wide`` of these, of ``wide`` times that, so that a long cue is not copied all over. The
    narrower the buckets, the fewer events a cue meets in vain and the more copies of it.
    parts: both sides are dealt to so many tasks first, where pairs are many more than what is read: small files are one
    task, and all of the pairs would be made there. Events stay near others of their time, which the join reads together."""
    keys = [by] if by else []
    if parts:
        events, cues = events.repartitionByRange(parts, "pts"), cues.repartition(parts)
    long = (F.col("end") - F.col("start")) > width * wide
    size = F.when(long, F.lit(width * wide)).otherwise(F.lit(width))
    spread = cues.withColumn("_l", long.cast("int")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    own = events.withColumn("_l", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", F.floor(F.col("pts") / F.when(F.col("_l") == 1, F.lit(width * wide)).otherwise(F.lit(width))))
    return own.join(spread, [*keys, "_l", "_b"]).filter("start <= pts and pts < end").select(*keys, "pts", "v", "cue")


def framerate(stream: DataFrame, tick: int, by: str, scene: float | None = None, bucket: int | None = None) -> DataFrame:
    """(by, slot, v): the stream at each multiple of ``tick``, linear between the records before and after it, from the
    first slot at or after the first record to the last one. Where these two differ by over ``scene``, the nearer holds."""
    d = previous(stream.select(by, "pts", "v", *tie(stream)), by, {"_np": F.col("pts"), "_nv": F.col("v")}, bucket, descending=True)
    first, last = F.ceil(F.col("pts") / tick), F.ceil(F.coalesce(F.col("_np"), F.col("pts") + 1) / tick) - 1
    d = d.filter(last >= first).withColumn("slot", F.explode(F.sequence(first, last)))
    t = (F.col("slot") * tick - F.col("pts")) / (F.col("_np") - F.col("pts"))
    line = F.col("v") + t * (F.col("_nv") - F.col("v"))
    if scene is not None:
        line = F.when(F.abs(F.col("_nv") - F.col("v")) > scene, F.when(t < 0.5, F.col("v")).otherwise(F.col("_nv"))).otherwise(line)
    return d.select(by, "slot", F.when(F.col("_np").isNull() | (F.col("_np") == F.col("pts")), F.col("v")).otherwise(line).alias("v"))


def fsync(stream: DataFrame, times: DataFrame, by: str, bucket: int | None = None) -> DataFrame:
    """(by, pts, v): the newest record at or before each of the listed times; none before the first record."""
    grid = times.select(by, "pts", F.lit(0.0).alias("v"))
    return asof(grid, stream, by, bucket=bucket).filter("other_pts is not null").select(by, "pts", F.col("other_v").alias("v"))


def sessions(stream: DataFrame, by: str, gap: int, bucket: int | None = None) -> DataFrame:
    """(by, start, end, records): records of which each is at most ``gap`` after the one before."""
    d = previous(stream, by, {"_p": F.col("pts")}, bucket)
    d = d.withColumn("_new", F.when(F.col("_p").isNull() | (F.col("pts") - F.col("_p") > gap), 1).otherwise(0))
    d = running(d, by, {"_s": ("sum", F.col("_new"))}, bucket)
    return d.groupBy(by, "_s").agg(F.min("pts").alias("start"), F.max("pts").alias("end"), F.count("*").alias("records")).drop("_s")

