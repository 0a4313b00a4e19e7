"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, train

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    return judge(_table(spark, sf_dir, "pages"))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe, encode_media, store_pcm

    return describe(store_pcm(encode_media(_table(spark, sf_dir, "documents"))))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import classes

    return classes(_table(spark, sf_dir, "documents"), words=3, distance=2)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_neighbours, op3_packing, op4_byte_bpe, op5_url_rules, op6_telephony, op7_language, op8_simhash, op9_licenses, op10_token_files)
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    from .url_rules import ORACLE

    return {"op5_url_rules": ORACLE}


ORACLE_SQL: dict[str, str] = oracle_sql()
