"""What a name of a source stands for: plain paths, and prefixes that wrap one.

``open_source`` gives (path, content) rows, one for each resource, read by Spark's own file systems: whatever scheme these know (file, http
where Hadoop has it, ftp, object stores) needs nothing here.
"""

from __future__ import annotations

import base64
import re
import urllib.parse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_data(spark: SparkSession, name: str) -> DataFrame:
    """``data:[type][;base64],content``."""
    head, _, body = name.removeprefix("data:").partition(",")
    raw = base64.b64decode(urllib.parse.unquote_to_bytes(body)) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    return spark.createDataFrame([(name, raw)], "path string, content binary")


def read_subfile(spark: SparkSession, name: str) -> DataFrame:
    """``subfile,,start,N,end,N,,:path``: bytes from start to end (0: the file's end)."""
    options, _, path = name.removeprefix("subfile").partition(":")
    parts = [x for x in options.split(",") if x]
    values = dict(zip(parts[::2], map(int, parts[1::2]), strict=True))
    start, end = values.get("start", 0), values.get("end", 0)
    whole = open_source(spark, path)
    length = F.lit(end - start) if end else F.octet_length("content") - start
    return whole.withColumn("content", F.substring(F.col("content"), F.lit(start + 1), F.greatest(F.lit(0), length)))


def read_concat(spark: SparkSession, name: str) -> DataFrame:
    """``concat:a|b|c``: the contents of several, one after another, as one."""
    return _joined(spark, name, [x for x in name.removeprefix("concat:").split("|") if x])


def read_concatf(spark: SparkSession, name: str) -> DataFrame:
    """``concatf:list``: as concat, of the lines of a file."""
    text = open_source(spark, name.removeprefix("concatf:")).first()["content"]
    return _joined(spark, name, [x for x in bytes(text).decode().split("\n") if x.strip()])


def _joined(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    out = None
    for k, p in enumerate(paths):
        own = open_source(spark, p).select(F.lit(k).alias("k"), F.hex("content").alias("h"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([(name, b"")], "path string, content binary")
    # one resource is one value: as large as Spark lets a row be
    held = out.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("p"))
    return held.select(F.lit(name).alias("path"), F.unhex(F.concat_ws("", F.transform("p", lambda x: x["h"]))).alias("content"))


def decrypted(content: Column, key: bytes, iv: bytes) -> Column:
    """AES-128 in CBC mode with padding."""
    return F.aes_decrypt(F.concat(F.lit(iv), content), F.lit(key), F.lit("CBC"))


def encrypted(content: Column, key: bytes, iv: bytes) -> Column:
    """As ``decrypted`` takes it: without the initial vector in front."""
    whole = F.aes_encrypt(content, F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv))
    return F.substring(whole, F.lit(17), F.octet_length(whole))


def read_crypto(spark: SparkSession, name: str, key: bytes, iv: bytes) -> DataFrame:
    """``crypto:path``."""
    return open_source(spark, re.sub(r"^crypto[:+]", "", name)).withColumn("content", decrypted(F.col("content"), key, iv))


def read_cached(spark: SparkSession, name: str) -> DataFrame:
    """``cache:path``: kept by the executors once read."""
    return open_source(spark, name.removeprefix("cache:")).persist()


#: prefix: reader. ``async`` reads ahead, which Spark does anyway.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "data:": read_data, "subfile,": read_subfile, "concat:": read_concat, "concatf:": read_concatf, "cache:": read_cached,
    "async:": lambda s, n: open_source(s, n.removeprefix("async:")), "file:": read_plain,
}


def open_source(spark: SparkSession, name: str) -> DataFrame:
    for prefix, reader in READERS.items():
        if name.startswith(prefix):
            return reader(spark, name)
    return read_plain(spark, name)


def write_tee(frame: DataFrame, targets: list[str], format: str = "parquet") -> None:
    """The same rows to several places; they are computed once."""
    kept = frame.persist()
    try:
        for path in targets:
            kept.write.format(format).mode("overwrite").save(path)
    finally:
        kept.unpersist()


def md5_of(packets: DataFrame, order: list[str]) -> str:
    """The checksum of all payloads in order, as one stream."""
    from .packets import stream_hash

    whole = packets.withColumn("_all", F.lit(0))
    row = stream_hash(whole, "_all", order).first()
    return row["hash"] if row else "d41d8cd98f00b204e9800998ecf8427e"
