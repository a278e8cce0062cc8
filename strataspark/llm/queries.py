"""The queries of this subpackage, one for each operator, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, linededup, ngram_bloom, ogg, pii, secrets, setsketch, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(read(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(read(spark, sf_dir, "documents"), key="synthetic tables only")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(read(spark, sf_dir, "documents"), with_media=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_bloom.score(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), word_bpe())


def word_bpe() -> str:
    """The tokenizer file of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Query]:
    found = (op1_toxicity, op2_line_dedup, op3_pii_surrogates, op4_minhash_near_dedup, op5_ogg_media, op6_secret_scan, op7_chat_formatting, op8_lm_scoring, op9_benchmark_decontamination, op10_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.SQL, "op9_benchmark_decontamination": decontam.SQL}
