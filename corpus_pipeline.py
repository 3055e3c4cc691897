"""The corpus pipeline: raw documents to packed windows of token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read
again, and removed once the next one is written. All but the last return the columns of documents, further ones too, whatever
their names.

Defined cases: null and empty texts have no words and fail the quality rules; very long texts: as any other; of repeated rows, and
of near copies, one stays; null doc_id: a row like others; null source: a source of its own; ties: by doc_id, then by the hash of
the text; empty table: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import mixing, near_dedup, packing, pii, quality
from quillmill.llm.common import discard, documents, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their frequent lines."""
    return quality.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicate(docs, near_dedup.STAGE_PERCENT)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order and number in which their sources' shares take them."""
    return mixing.mixture(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of token ids."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), with_ids=False)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can express neither the tokenizer nor the hashes of the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if hasattr(before, "scratch"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
