"""Packet logs: checksum sinks and the inspector's text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame_hash(packets: DataFrame, kind: str = "md5") -> DataFrame:
    """Adds ``hash`` of each payload, in lower-case hexadecimal."""
    data = F.col("payload").cast("binary")
    makers = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "crc32": lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")}
    if kind == "adler32":
        return packets.withColumn("hash", adler32(data))
    return packets.withColumn("hash", makers[kind](data))


def adler32(payload: Column) -> Column:
    """Adler-32 with a zero start, as the per-packet checksum sinks write it. No built-in function has it."""

    def each(values: pd.Series) -> pd.Series:
        import zlib

        return values.map(lambda b: None if b is None else f"{zlib.adler32(b, 0):08x}")

    return F.pandas_udf(each, T.StringType())(payload)


def show_entries(packets: DataFrame, entries: str) -> DataFrame:
    """Only the named columns, in the order of the table: the scan reads no others."""
    names = {e.strip() for e in entries.split(",")}
    return packets.select(*[c for c in packets.columns if c in names])


def read_intervals(packets: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """The first ``count`` packets of each stream."""
    return packets.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= count).drop("_n")


def compact(columns: list[str], section: str = "packet", separator: str = "|") -> Column:
    """A line ``section|key=value|...`` of each row."""
    return F.concat_ws(separator, F.lit(section), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in columns])


def csv_line(columns: list[str], section: str = "packet") -> Column:
    """A line of values; those with a comma, quote or line feed are quoted."""
    quoted = lambda c: F.when(F.col(c).cast("string").rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("N/A")))
    return F.concat_ws(",", F.lit(section), *map(quoted, columns))


def flat(columns: list[str], prefix: str) -> Column:
    """Lines ``prefix.key="value"`` of each row."""
    return F.concat_ws("\n", *[F.concat(F.lit(f'{prefix}.{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("N/A")), F.lit('"')) for c in columns])


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("N/A"))


def default_section(columns: list[str], section: str = "packet", nokey: bool = False, noprint_wrappers: bool = False) -> Column:
    """Lines ``key=value`` between ``[SECTION]`` and ``[/SECTION]``, each with its line feed."""
    lines = [_value(c) if nokey else F.concat(F.lit(f"{c}="), _value(c)) for c in columns]
    body = F.concat(*[F.concat(x, F.lit("\n")) for x in lines])
    return body if noprint_wrappers else F.concat(F.lit(f"[{section.upper()}]\n"), body, F.lit(f"[/{section.upper()}]\n"))


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def ini_section(columns: list[str], path: Column, hierarchical: bool = True) -> Column:
    """A header ``[path]`` and lines ``key=value``; backslashes, control characters, ``#``, ``;``, ``=`` and ``:`` are escaped."""
    table = {"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "#": "\\#", "=": "\\=", ":": "\\:", ";": "\\;"}
    lines = [F.concat(F.lit(f"{c}="), _replaced(_value(c), table), F.lit("\n")) for c in columns]
    return F.concat(F.lit("["), path if hierarchical else F.element_at(F.split(path, r"\."), -1), F.lit("]\n"), *lines)


def json_object(columns: list[str]) -> Column:
    """An object on a line; whole numbers as numbers, all else as strings, nulls left out."""
    table = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    text = lambda c: F.concat(F.lit('"'), _replaced(F.col(c).cast("string"), table), F.lit('"'))
    value = lambda c: F.when(F.typeof(F.col(c)).isin("tinyint", "smallint", "int", "bigint"), F.col(c).cast("string")).otherwise(text(c))
    # nulls are left out by concat_ws
    return F.concat(F.lit("{ "), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in columns]), F.lit(" }"))


def xml_element(columns: list[str], section: str = "packet") -> Column:
    """An element with an attribute for each value; nulls left out."""
    table = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
    attributes = [F.concat(F.lit(f'{c}="'), _replaced(F.col(c).cast("string"), table), F.lit('"')) for c in columns]
    return F.concat(F.lit(f"<{section} "), F.concat_ws(" ", *attributes), F.lit("/>"))


def flat_section(columns: list[str], path: Column) -> Column:
    """Lines ``path.key=value``; strings in quotes, with backslashes, quotes, dollars, backticks and line ends escaped."""
    table = {"\\": "\\\\", '"': '\\"', "`": "\\`", "$": "\\$", "\n": "\\n", "\r": "\\r"}
    value = lambda c: F.when(F.typeof(F.col(c)).isin("tinyint", "smallint", "int", "bigint"), _value(c)).otherwise(F.concat(F.lit('"'), _replaced(_value(c), table), F.lit('"')))
    return F.concat_ws("\n", *[F.concat(path, F.lit(f".{c}="), value(c)) for c in columns])


def mermaid_edges(nodes: list[str], links: list[tuple[str, str, str]]) -> str:
    """A graph of operators as text: nodes, and links (from, to, label)."""
    return "flowchart LR\n" + "".join(f"  {k}[{n}]\n" for k, n in enumerate(nodes)) + "".join(f"  {nodes.index(a)} -->|{label}| {nodes.index(b)}\n" for a, b, label in links)


#: What a missing time stamp is written as.
MISSING = -(1 << 63)


def frame_lines(packets: DataFrame, kind: str = "crc") -> DataFrame:
    """Adds ``line`` of each packet (stream, dts, pts, duration, payload, flags): its numbers in columns of fixed widths and its
    checksum. crc: Adler-32 from zero, and the flags unless they are exactly ``key`` (1); else a hash of ``frame_hash``."""
    stamp = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(MISSING))
    size = F.coalesce(F.octet_length(F.col("payload").cast("binary")), F.lit(0))
    head = F.format_string("%d, %10d, %10d, %8d, %8d, ", F.col("stream"), stamp("dts"), stamp("pts"), F.coalesce(F.col("duration").cast("long"), F.lit(0).cast("long")), size)
    found = frame_hash(packets, "adler32" if kind == "crc" else kind)
    if kind != "crc":
        return found.withColumn("line", F.concat(head, "hash")).drop("hash")
    flags = F.when(F.col("flags") == 1, F.lit("")).otherwise(F.concat(F.lit(", F=0x"), F.lower(F.hex(F.coalesce(F.col("flags").cast("long"), F.lit(0).cast("long"))))))
    return found.withColumn("line", F.concat(head, F.lit("0x"), "hash", flags)).drop("hash")


def stream_hash(packets: DataFrame, by: str, order: list[str], kind: str = "md5") -> DataFrame:
    """(by, hash) of all payloads of a stream, in order. adler32 combines those of the packets, so that nothing is gathered but
    two numbers for each; other hashes go over the packets in one task for each stream, one batch after another."""
    if kind == "adler32":
        return _joined_adler(packets, by, order)
    from collections.abc import Iterator

    import pyarrow as pa

    rows = packets.select(by, *order, F.col("payload").cast("binary").alias("payload")).repartition(by).sortWithinPartitions(by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, data in zip(batch.column(by).to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = k, hashlib.new(kind)
                state.update(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(by).type), pa.array(found, pa.string())], names=[by, "hash"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.column(by).type), pa.array([state.hexdigest()])], names=[by, "hash"])

    return rows.mapInArrow(run, T.StructType([packets.schema[by], T.StructField("hash", T.StringType())]))


def _joined_adler(packets: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Sums modulo 65521: the second sum of a packet counts the first sum of all before it once for each of its bytes."""
    base = 65521
    own = frame_hash(packets, "adler32").select(by, *order, F.coalesce(F.octet_length(F.col("payload").cast("binary")), F.lit(0)).cast("long").alias("n"), F.conv(F.coalesce("hash", F.lit("0")), 16, 10).cast("long").alias("h"))
    own = own.withColumns({"a": F.col("h") % 65536, "b": F.floor(F.col("h") / 65536)})
    before = F.coalesce(F.sum("a").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = own.withColumn("more", (before % base) * (F.col("n") % base) % base)
    # from 1 and 0, as the checksum of a whole stream: the first sum has one more, and the second one for each byte
    sums = parts.groupBy(by).agg(((F.sum("a") + 1) % base).alias("a"), ((F.sum("b") + F.sum("more") + F.sum("n")) % base).alias("b"))
    return sums.select(by, F.lpad(F.lower(F.hex(F.col("b") * 65536 + F.col("a"))), 8, "0").alias("hash"))
