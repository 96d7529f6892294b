"""From raw documents to training tokens: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``:

1. quality: documents that fail the rules or their source's adaptive limits go;
2. near_dedup: of each class of exact and near copies the smallest id stays;
3. secrets: found secrets are masked in the text, and n_chars set anew;
4. mix: sources are replicated or thinned towards their target weights, shuffled;
5. encode: whole texts are encoded and decoded; ids and texts leave as digests.

Rows with null text fail the quality rules. An empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantide.llm import bpe, mixing, near_dedup, quality, secrets
from quantide.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs, copy=None)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: SQL can't express near-duplicate signatures and BPE; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
