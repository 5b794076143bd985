"""A training corpus from raw documents: filter, deduplicate, mix, tokenise.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  Stages read stored rows: :func:`run`, like any
other caller, writes what a stage returns as Parquet and reads it again for the next one, so two
passes of a stage over its input see the same rows.  All stages but the last keep the columns of ``docs``
as they are, whatever further columns there are.

Nulls, empty texts, repeated rows and empty tables: see the operators' docstrings.  A null text is scored, compared and
encoded like the empty text and stays null until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slantscope.llm import bpe, exact_dedup, mixing, simhash, toxicity
from slantscope.llm.common import Scratch, importable

VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (SimHash, 3-word shingles, 3 bits), the row with the smallest doc_id stays."""
    importable(spark)
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return mixing.training_order(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded bytes, one row per row of ``docs``."""
    importable(spark)
    ids = bpe.encode(docs, VOCAB, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(ids, VOCAB))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A fitted model decides the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored, the last one's are returned."""
    t = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, t.put(stage(spark, docs, sf_dir))
        t.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
