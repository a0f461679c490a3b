"""Queries of the numbered operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import op1

    return op1(_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import op2

    return op2(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import op3

    return op3(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import op4

    return op4(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import op5

    return op5(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import op6

    return op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op7

    return op7(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import op8

    return op8(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import op9

    return op9(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op10

    return op10(_table(spark, sf_dir, "documents"))


def op11_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edits import op11

    return op11(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import op12

    return op12(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import op13

    return op13(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_warc, op2_sharding, op3_topk, op4_mixing, op5_line_dedup, op6_decontamination, op7_quality, op8_substring_dedup, op9_token_output,
        op10_simhash, op11_edit_embedding, op12_tokenizer_alignment, op13_whitening,
    )}


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; hashes, fitted models and tokenizers are beyond it."""
    from . import decontamination, mixing, substrings, topk, warc

    return {
        "op1_warc": warc.ORACLE_SQL,
        "op3_topk": topk.ORACLE_SQL,
        "op4_mixing": mixing.ORACLE_SQL,
        "op6_decontamination": decontamination.ORACLE_SQL,
        "op8_substring_dedup": substrings.ORACLE_SQL,
    }
