"""Helpers shared by the Arrow-batched operators: bounded slices of batches, ragged words, null-safe texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: Text bytes that one step works on; a longer text is a step of its own.
SLICE_BYTES = 4 << 20


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that are needed, with fixed types; a null text counts as empty. Other columns can't clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def bound_batches(spark) -> None:
    """Arrow batches to Python stay small in bytes, whatever the length of the texts; workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_bytes(col: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of a string array, as one view."""
    if len(col) == 0 or col.buffers()[2] is None:
        return np.empty(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def plain(col: pa.Array) -> pa.Array:
    """A string array of its own, without offset (kernels and buffers are then simple)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pa.concat_arrays([col]) if col.offset == 0 else pc.take(col, pa.array(np.arange(len(col))))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i]+1, ...`` of all i, ``lengths[i]`` of each."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def split_words(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Splits at ASCII white space: (distinct words, index of each word, bounds of each row's words)."""
    parts = pc.ascii_split_whitespace(col)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), bounds - bounds[0]
