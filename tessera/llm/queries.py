"""One query per operator of this subpackage, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chunked_bpe, importance, language_id, minhash, ngram_bloom, pareto_mix, pii_scan, secret_scan, suffix_array, token_frames, transport_stream, warc
from .runtime import bounded, table

TOKENIZER = "word_bpe_49k.json"


def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(bounded(spark), sf_dir, "pages"))


def op2_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.digest(table(bounded(spark), sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(bounded(spark), sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(bounded(spark), sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_bloom.digest(table(bounded(spark), sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digest(table(bounded(spark), sf_dir, "documents"), table(bounded(spark), sf_dir, "benchmark"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.digest(table(bounded(spark), sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.digest(table(bounded(spark), sf_dir, "documents"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digest(table(bounded(spark), sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(bounded(spark), sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(bounded(spark), sf_dir, "documents"), table(bounded(spark), sf_dir, "benchmark"))


def op12_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_records, op2_chunked_bpe, op3_language_id, op4_secret_scan, op5_lm_score, op6_decontaminate, op7_token_frames, op8_pii_scan, op9_transport_stream, op10_minhash_dedup, op11_importance, op12_pareto_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_records": warc.ORACLE_SQL, "op6_decontaminate": suffix_array.ORACLE_SQL, "op10_minhash_dedup": minhash.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_pareto_mix": pareto_mix.ORACLE_SQL}
