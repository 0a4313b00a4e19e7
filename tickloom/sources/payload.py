"""Functions of whole payloads (bytes of a packet or a file), run on Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship


def _bounded(frame: DataFrame) -> None:
    ship(frame.sparkSession)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def each(frame: DataFrame, f: Callable[..., tuple], columns: list[str], added: str) -> DataFrame:
    """Adds the columns that ``added`` declares: ``f`` takes a row's ``columns`` and gives their values. Older columns of these
    names are replaced; a null first column gives nulls."""
    return rows(frame, lambda *values: [f(*values)], columns, added, keep_nulls=True)


def rows(frame: DataFrame, f: Callable[..., Iterable[tuple]], columns: list[str], added: str, keep_nulls: bool = False) -> DataFrame:
    """As ``each``, but ``f`` gives any number of new rows for a row, which keep its other columns."""
    _bounded(frame)
    fields = T._parse_datatype_string(added).fields
    own = frame.drop(*[x.name for x in fields if x.name in frame.columns and x.name not in columns])
    kept = [x for x in own.schema.fields if x.name not in {y.name for y in fields}]
    kinds = [to_arrow_type(x.dataType) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(c).to_pylist() for c in columns]
            places, made = [], []
            for k, values in enumerate(zip(*inputs, strict=True)):
                found = ([(None,) * len(fields)] if keep_nulls else []) if values[0] is None else f(*values)
                for row in found:
                    places.append(k)
                    made.append(row)
            at = pa.array(places, pa.int64())
            new = [pa.array([row[k] for row in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x.name).take(at) for x in kept], *new], names=[*[x.name for x in kept], *[x.name for x in fields]])

    return own.mapInArrow(run, T.StructType([*kept, *fields]))
