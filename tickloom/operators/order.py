"""Ordered primitives on streams: numbers, neighbours and running aggregates, and a scan that carries state.

A stream is a value of ``by``; its records are ordered by ``pts`` and, where there is one, by the column ``arrival``, so
that equal time stamps have an order. With ``bucket`` (ticks) a stream is dealt to time buckets: windows run within a
bucket, and one row for each bucket carries on what the earlier ones hold. A long stream is then many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: How a running aggregate is taken, and how that of earlier buckets is joined to it.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def tie(stream: DataFrame) -> list[str]:
    """What breaks ties of equal time stamps."""
    return ["arrival"] if "arrival" in stream.columns else []


def ordered(by: str, *more: str) -> Window:
    return Window.partitionBy(by).orderBy("pts", *more)


def _order(stream: DataFrame, first: tuple[str, ...], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in ("pts", *first, *tie(stream))]


def dealt(stream: DataFrame, bucket: int) -> DataFrame:
    """Adds the bucket ``_b``; records without a time stamp come first."""
    return stream.withColumn("_b", F.coalesce(F.floor(F.col("pts") / bucket), F.lit(-(1 << 62))))


def running(stream: DataFrame, by: str, columns: dict[str, tuple[str, Column]], bucket: int | None = None, first: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """Adds running aggregates from the stream's first record to each one: name to (kind, value), kinds as in ``KINDS``.

    first: columns that order records of one time stamp. descending: from the last record back to each one."""
    order = _order(stream, first, descending)
    if bucket is None:
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return stream.withColumns({name: KINDS[kind][0](value).over(w) for name, (kind, value) in columns.items()})
    rows = dealt(stream, bucket)
    w = Window.partitionBy(by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[F.col(c) for c in ("pts", *first, *tie(stream))])
    newest = (lambda v: F.min_by(v, F.when(v.isNotNull(), place))) if descending else (lambda v: F.max_by(v, F.when(v.isNotNull(), place)))
    held = rows.groupBy(by, "_b").agg(*[(newest(v) if kind == "last" else KINDS[kind][0](v)).alias(f"_{name}") for name, (kind, v) in columns.items()])
    before = Window.partitionBy(by).orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    again = lambda kind: F.sum if kind == "count" else KINDS[kind][0]
    carry = held.select(by, "_b", *[again(kind)(F.col(f"_{name}")).over(before).alias(f"_{name}") for name, (kind, _) in columns.items()])
    out = rows.withColumns({name: KINDS[kind][0](value).over(w) for name, (kind, value) in columns.items()}).join(carry, [by, "_b"])
    return out.withColumns({name: KINDS[kind][1](F.col(f"_{name}"), F.col(name)) for name, (kind, _) in columns.items()}).drop("_b", *[f"_{n}" for n in columns])


def previous(stream: DataFrame, by: str, columns: dict[str, Column], bucket: int | None = None, descending: bool = False) -> DataFrame:
    """Adds values of the record before (``descending``: after) each one, null for the first one."""
    order = _order(stream, (), descending)
    if bucket is None:
        w = Window.partitionBy(by).orderBy(*order)
        return stream.withColumns({name: F.lag(value).over(w) for name, value in columns.items()})
    rows = dealt(stream, bucket)
    whole = F.struct(*[v.alias(name) for name, v in columns.items()])
    place = F.struct(*[F.col(c) for c in ("pts", *tie(stream))])
    edge = (F.min_by if descending else F.max_by)(whole, place)
    ends = rows.groupBy(by, "_b").agg(edge.alias("_end"))
    carry = ends.select(by, "_b", F.lag("_end").over(Window.partitionBy(by).orderBy(F.desc("_b") if descending else F.asc("_b"))).alias("_end"))
    out = rows.withColumn("_inner", F.lag(whole).over(Window.partitionBy(by, "_b").orderBy(*order))).join(carry, [by, "_b"])
    return out.withColumns({name: F.when(F.col("_inner").isNull(), F.col(f"_end.{name}")).otherwise(F.col(f"_inner.{name}")) for name in columns}).drop("_b", "_inner", "_end")


def numbered(stream: DataFrame, by: str, name: str = "_n", bucket: int | None = None) -> DataFrame:
    """Adds the number of each record in its stream, from 0."""
    if bucket is None:
        return stream.withColumn(name, F.row_number().over(ordered(by, *tie(stream))) - 1)
    return running(stream, by, {name: ("count", F.lit(1))}, bucket).withColumn(name, F.col(name) - 1)


def scan(stream: DataFrame, by: str, columns: list[str], out: str, start: Callable[[], object], step: Callable[[object, list[np.ndarray]], tuple[object, np.ndarray]], numbers: str = "double") -> DataFrame:
    """Adds ``out``, made by a recursion in order: for operators whose state no window can give.

    ``start()`` is the state before a stream's first record; ``step(state, arrays)`` takes consecutive records of one
    stream (the named columns, nulls as NaN) and gives the new state and their values. Records come sorted from one shuffle and are
    worked on batch by batch: a task holds one batch and one state, however long the streams. A stream is one task's,
    since each of its records depends on all before.
    """
    ship(stream.sparkSession)
    order = ["pts", *tie(stream)]
    rows = stream.repartition(by).sortWithinPartitions(by, *order)
    schema = T.StructType([*stream.schema.fields, T.StructField(out, T._parse_datatype_string(numbers))])
    kind = pa.int64() if numbers in ("long", "bigint") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            keys = batch.column(by).to_pylist()
            values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
            found = np.empty(len(keys), np.float64 if kind == pa.float64() else np.int64)
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if at or keys[0] != key or state is None:
                    state = start()
                key = keys[at]
                state, found[at:to] = step(state, [v[at:to] for v in values])
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
