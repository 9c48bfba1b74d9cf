"""A corpus pipeline: each stage takes what the one before it kept.

Every stage is (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of docs.

Edge cases: null texts and texts without a letter go in the first stage, so do all documents if no row has a language to
learn; rows with the same doc_id stay or go together in near-dedup and are judged each by itself in the other
stages; of equal documents the one with the smallest doc_id stays, rows with a null doc_id always do; long texts
are used whole; further columns are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, language, neardup, secrets
from quarry.llm._shared import forget, packed, unpacked, written
from quarry.llm.queries import held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null texts and texts without a letter.

    The profiles are those of op10: fitted on a bounded sample of the labelled rows of docs.
    """
    profiles = language.fit_profiles(docs.where(~held_out()))
    named = language.predict(packed(docs), profiles, keep=("__row", "text"))
    return unpacked(named.where(F.col("lang_pred") != language.UNKNOWN), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.fitted(spark, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the digests of its ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("byte-level BPE", encode)]
#: SQL has neither the profiles, the forest nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's result but the last is written before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
            if before is not None:
                forget(before)
            before = docs
    return docs
