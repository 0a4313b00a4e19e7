"""Bounded, repeatable samples of labelled rows for fitting, and the folds that contracts fix."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def stratified(rows: DataFrame, label: str, key: str, each: int | dict) -> DataFrame:
    """About ``each`` rows (or a number for each value) of every label value, or all of a rarer one, chosen by a hash of ``key``.

    Only one count for each label value reaches the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = None
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        test, part = F.col(label) == F.lit(value), F.lit(min(1.0, (each.get(value, 0) if isinstance(each, dict) else each) / n))
        share = F.when(test, part) if share is None else share.when(test, part)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of a bounded sample, run in one task: the driver holds the model alone, and a lost executor only repeats it.

    The rows reach ``fit`` in no certain order."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := list(batches)) else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else fit(schema.empty_table())
