"""Operators on time stamps of streams. A stream is a value of ``by``; its records are ordered by ``pts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import condition, parse, to_column, uses
from .order import numbered, ordered, previous, running, scan, tie


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time stamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def rescale(value: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    """Ticks of one time base as ticks of another, in exact decimals, halves away from zero."""
    num, den = source[0] * target[1], source[1] * target[0]
    twice = F.abs(value).cast("decimal(20,0)") * F.lit(2 * num).cast("decimal(17,0)") + F.lit(den)
    whole = (twice - twice % F.lit(2 * den)) / F.lit(2 * den)
    return (F.signum(value).cast("long") * whole.cast("long")).cast("long")


#: Variables of ``select`` and ``setpts`` besides n: what they stand for, given the names of columns made for them.
SELECT_VARIABLES = {"pts": "pts", "v": "v", "start_pts": "_start", "prev_pts": "_prev", "prev_v": "_prev_v"}


def variables(stream: DataFrame, expression: str, by: str, tick: float = 1e-6, bucket: int | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The stream with what an expression asks for, and each variable's column: n (from 0), pts, t (seconds), tb, v, start_pts,
    start_t, prev_pts, prev_t, prev_v (NaN for the first record), scene (the absolute difference to the record before)."""
    known = {*SELECT_VARIABLES, "n", "t", "tb", "start_t", "prev_t", "scene"}
    tree = parse(expression, known)
    out = stream.withColumn("_n", F.lit(0))
    if uses(tree, "n"):  # records are numbered, which takes a sort, only if the expression asks for it
        out = numbered(stream, by, bucket=bucket)
    if uses(tree, "start_pts") or uses(tree, "start_t"):
        out = running(out, by, {"_start": ("min", F.col("pts"))}, bucket)
    if any(uses(tree, x) for x in ("prev_pts", "prev_t", "prev_v", "scene")):
        out = previous(out, by, {"_prev": F.col("pts"), "_prev_v": F.col("v")}, bucket)
    found = {"n": F.col("_n"), "t": F.col("pts") * tick, "tb": F.lit(tick)}
    found |= {k: F.col(c) if c in out.columns else F.lit(None).cast("double") for k, c in SELECT_VARIABLES.items()}
    found |= {"start_t": found["start_pts"] * tick, "prev_t": found["prev_pts"] * tick, "scene": F.coalesce(F.abs(found["v"] - found["prev_v"]), F.lit(0.0))}
    return out, found


def select(stream: DataFrame, expression: str, by: str, bucket: int | None = None) -> DataFrame:
    """Records for which the expression holds; see ``variables``."""
    out, found = variables(stream, expression, by, bucket=bucket)
    return out.filter(condition(expression, found)).select(*stream.columns)


def enabled(stream: DataFrame, expression: str, by: str, operator, bucket: int | None = None) -> DataFrame:
    """``operator`` of the stream, where it changes ``v`` record by record, only for records for which the expression holds: others pass unchanged."""
    out, found = variables(stream.withColumn("_old", F.col("v")), expression, by, bucket=bucket)
    out = out.withColumn("_on", condition(expression, found)).select(*stream.columns, "_old", "_on")
    return operator(out).withColumn("v", F.when(F.col("_on"), F.col("v")).otherwise(F.col("_old"))).drop("_old", "_on")


def setpts(stream: DataFrame, expression: str, by: str, tick: float = 1e-6, bucket: int | None = None) -> DataFrame:
    """New time stamps by an expression, cut to whole ticks. Variables: PTS, STARTPTS, N, T, STARTT, TB, PREV_INPTS, PREV_INT, and
    PREV_OUTPTS, PREV_OUTT, for which records are taken in order. Before the first record the PREV ones are NaN."""
    names = {"PTS", "STARTPTS", "N", "T", "STARTT", "TB", "PREV_INPTS", "PREV_INT", "PREV_OUTPTS", "PREV_OUTT"}
    tree = parse(expression, names)
    out = running(numbered(stream, by, bucket=bucket), by, {"_start": ("min", F.col("pts"))}, bucket)
    out = previous(out, by, {"_prev": F.col("pts")}, bucket)
    if uses(tree, "PREV_OUTPTS") or uses(tree, "PREV_OUTT"):
        from ..functions.expr import evaluate

        def step(state, arrays):
            registers, last, new = state[0], state[1], []
            for n, pts, start, prev in zip(*arrays, strict=True):
                values = {"PTS": pts, "STARTPTS": start, "N": n, "T": pts * tick, "STARTT": start * tick, "TB": tick, "PREV_INPTS": prev, "PREV_INT": prev * tick, "PREV_OUTPTS": last, "PREV_OUTT": last * tick}
                x = evaluate(tree, values, registers)
                last = float("nan") if x != x else float(int(x))
                new.append(last)
            return (registers, last), new

        out = scan(out, by, ["_n", "pts", "_start", "_prev"], "_new", lambda: ([0.0] * 10, float("nan")), step)
        return out.withColumn("pts", F.when(~F.isnan("_new"), F.col("_new").cast("long"))).select(*stream.columns)
    found = {"PTS": F.col("pts"), "STARTPTS": F.col("_start"), "N": F.col("_n"), "T": F.col("pts") * tick, "STARTT": F.col("_start") * tick, "TB": F.lit(tick), "PREV_INPTS": F.col("_prev"), "PREV_INT": F.col("_prev") * tick}
    x = to_column(expression, found)
    return out.withColumn("pts", F.when(~F.isnan(x), x.cast("long"))).select(*stream.columns)


def dejudder(stream: DataFrame, cycle: int, by: str) -> DataFrame:
    """Each step of pts becomes the mean of the last ``cycle`` steps, rounded; from the first time stamp on."""
    import math

    def step(state, arrays):
        last_in, last_out, held = state
        new = []
        for x in arrays[0]:
            if last_in is None:
                last_out = x
            else:
                held = [*held, x - last_in][-cycle:]
                mean = sum(held) / len(held)
                last_out += math.copysign(math.floor(abs(mean) + 0.5), mean)
            last_in = x
            new.append(int(last_out))
        return (last_in, last_out, held), new

    return scan(stream.filter("pts is not null"), by, ["pts"], "_new", lambda: (None, None, []), step, "long").withColumn("pts", F.col("_new")).drop("_new")


def asetrate(stream: DataFrame, old: int, new: int) -> DataFrame:
    """The same samples at another rate: time stamps shrink or stretch."""
    return stream.withColumn("pts", rescale(F.col("pts"), (1, new), (1, old)))


def tpad(stream: DataFrame, by: str, tick: int, start: int = 0, stop: int = 0, start_mode: str = "add", stop_mode: str = "add", value: float = 0.0) -> DataFrame:
    """(by, pts, v): ``start`` records before a stream and ``stop`` after it, ``tick`` apart: of ``value`` (add), or copies of the
    nearest record (clone). The stream moves back by what comes before it."""
    ties = F.struct("pts", *tie(stream))
    ends = stream.groupBy(by).agg(F.min("pts").alias("_a"), F.max("pts").alias("_z"), F.min_by("v", ties).alias("_first"), F.max_by("v", ties).alias("_last"))
    moved = stream.select(by, (F.col("pts") + start * tick).alias("pts"), "v")
    out = moved
    if start:
        rows = ends.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(start - 1))))
        out = out.unionAll(rows.select(by, F.col("_a") + F.col("_k") * tick, F.col("_first") if start_mode == "clone" else F.lit(value)))
    if stop:
        rows = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(stop))))
        out = out.unionAll(rows.select(by, F.col("_z") + (F.col("_k") + start) * tick, F.col("_last") if stop_mode == "clone" else F.lit(value)))
    return out


def shuffleframes(stream: DataFrame, mapping: list[int], by: str, bucket: int | None = None) -> DataFrame:
    """(by, pts, v): within groups of as many records as ``mapping`` has, the k-th place takes the value of record mapping[k], or goes
    (-1). An incomplete last group stays as it is."""
    size = len(mapping)
    d = numbered(stream.select(by, "pts", "v", *tie(stream)), by, bucket=bucket).withColumn("_g", F.floor(F.col("_n") / size))
    whole = Window.partitionBy(by, "_g")
    values = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("v").alias("v"))).over(whole))
    d = d.withColumn("_all", values).withColumn("_to", F.get(F.array(*map(F.lit, mapping)), (F.col("_n") % size).cast("int")))
    full = F.size("_all") == size
    new = F.when(full & (F.col("_to") >= 0), F.get("_all", F.col("_to"))["v"]).otherwise(F.col("v"))
    return d.filter(~full | (F.col("_to") >= 0)).select(by, "pts", new.alias("v"))


def route(stream: DataFrame, expression: str, outputs: int) -> DataFrame:
    """Adds ``output``: ceil(expression) - 1, at least 0 and below ``outputs``; negative values and NaN go to 0."""
    x = to_column(expression, {"pts": F.col("pts"), "v": F.col("v")})
    return stream.withColumn("output", F.when(F.isnan(x) | (x < 0), 0).otherwise(F.least(F.lit(outputs - 1), F.greatest(F.lit(0), F.ceil(x) - 1))).cast("int"))


def trim(stream: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records with start <= pts < end; time stamps stay as they are."""
    out = stream if start is None else stream.filter(F.col("pts") >= start)
    return out if end is None else out.filter(F.col("pts") < end)


def rebase(stream: DataFrame, by: str) -> DataFrame:
    """pts less the first one of the stream."""
    return stream.withColumn("pts", F.col("pts") - F.min("pts").over(Window.partitionBy(by)))


def framestep(stream: DataFrame, step: int, by: str, bucket: int | None = None) -> DataFrame:
    """Every ``step``-th record of a stream, from its first."""
    return numbered(stream, by, bucket=bucket).filter(F.col("_n") % step == 0).drop("_n")


def fps(stream: DataFrame, tick: int, by: str, bucket: int | None = None) -> DataFrame:
    """(by, slot, pts, v): a record for each slot of ``tick``, held until the next record's slot; the last one is
    held as long as its predecessor, at least once. Records that are overtaken in their slot are dropped."""
    held = stream.withColumn("slot", F.floor((F.col("pts") + tick // 2) / tick))
    held = previous(held, by, {"_before": F.col("slot")}, bucket)
    held = previous(held, by, {"_next": F.col("slot")}, bucket, descending=True)
    gap = F.greatest(F.lit(1), F.col("slot") - F.col("_before"))
    end = F.coalesce("_next", F.col("slot") + F.coalesce(gap, F.lit(1)))
    return held.filter(end > F.col("slot")).withColumn("slot", F.explode(F.sequence(F.col("slot"), end - 1))).select(by, "slot", "pts", "v")


def concat(streams: DataFrame, by: str, gap: int = 1, parts: int = 256) -> DataFrame:
    """Streams one after another in the order of their names: pts starts where the one before ended, plus ``gap``.

    Offsets are sums of lengths in two steps: within ranges of names, and over the ranges, of which there are ``parts``."""
    spans = streams.groupBy(by).agg(F.min("pts").alias("_first"), (F.max("pts") - F.min("pts") + gap).alias("_length"))
    # one row for each stream, sorted by name: a partition is a range of names
    ranged = spans.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(F.sum("_length").alias("_total"))
    before_part = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_length").over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.withColumn("_within", within).join(F.broadcast(before_part), "_part").select(by, "_first", (F.col("_within") + F.col("_base")).alias("_offset"))
    return streams.join(offsets, by).withColumn("pts", F.col("pts") - F.col("_first") + F.col("_offset")).drop("_first", "_offset")


def segment(stream: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``segment``: how many of the bounds are at or before pts."""
    return stream.withColumn("segment", sum((F.when(F.col("pts") >= b, 1).otherwise(0) for b in bounds), F.lit(0)))


def reverse(stream: DataFrame, by: str, bucket: int | None = None) -> DataFrame:
    """Values in reverse order on the same time stamps."""
    own = numbered(stream, by, bucket=bucket)
    last = stream.groupBy(by).agg((F.count("*") - 1).alias("_last"))
    other = own.select(by, F.col("_n").alias("_m"), F.col("v").alias("_v")).join(last, by).select(by, (F.col("_last") - F.col("_m")).alias("_n"), "_v")
    return own.drop("v").join(other, [by, "_n"]).withColumnRenamed("_v", "v").drop("_n")


def loop(stream: DataFrame, times: int, size: int, by: str, bucket: int | None = None) -> DataFrame:
    """The first ``size`` records are repeated ``times`` more; (by, position, v), positions from 0."""
    numbers = numbered(stream.select(by, "pts", "v", *tie(stream)), by, bucket=bucket)
    head = stream.groupBy(by).agg(F.least(F.lit(size), F.count("*")).alias("_head"))
    rounds = F.when(F.col("_n") < size, F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(times)))
    return numbers.join(head, by).withColumn("_r", F.explode(rounds)).select(by, (F.col("_n") + F.col("_r") * F.col("_head")).cast("long").alias("position"), "v")


def interleave(*streams: DataFrame) -> DataFrame:
    """Records of several streams in order of pts; ``input`` numbers the streams and breaks ties."""
    out = None
    for k, s in enumerate(streams):
        own = s.select(F.lit(k).alias("input"), "pts", "v")
        out = own if out is None else out.unionByName(own)
    return out.sort("pts", "input")


def dedup(stream: DataFrame, by: str) -> DataFrame:
    """Drops records whose pts isn't after that of the record before."""
    return stream.withColumn("_last", F.lag("pts").over(ordered(by, *tie(stream), "v"))).filter("_last is null or pts > _last").drop("_last")


def late_dropped(stream: DataFrame, by: str, order: str) -> DataFrame:
    """Drops records whose pts is below that of an earlier one, where ``order`` says which came earlier."""
    newest = F.max("pts").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return stream.withColumn("_m", newest).filter("_m is null or pts >= _m").drop("_m")
