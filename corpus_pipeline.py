"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents:
1. language_id: rows go whose text is null, has no letter or costs 8 bits a byte or more in every learned language.
2. near_dedup: of each group of near copies (runs of five words, similarity 0.8 or more) the least doc_id stays.
3. decontaminate: rows go that hold a window of ten words of a benchmark item.
4. secret_scan: spans of secrets are replaced by a mark and n_chars is counted anew; no row goes.
5. bpe: the columns of documents but text, then n_tokens, ids and the digest of the decoded text.

A null doc_id is an id like others. Repeated rows: one stays after stage 2. Extra columns are carried along. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chunked_bpe, language_id, minhash, secret_scan, suffix_array
from tessera.llm.runtime import bounded, dropped, stored, table

TOKENIZER = "word_bpe_49k.json"


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return language_id.accepted(docs, language_id.learn(docs, language_id.learned_rows()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return suffix_array.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return secret_scan.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return chunked_bpe.tokenized(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_copies),
    ("decontaminate", decontaminate),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

#: Byte context trees, near copies and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            dropped(docs)
        docs = after
    return docs
