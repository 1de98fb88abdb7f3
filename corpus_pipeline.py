"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next one's documents.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import digest_index, language, mixing, parity_join, piece_bpe
from tidemark.llm.common import documents, drop_staged, staged, staged_so_far
from tidemark.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.recognised(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays."""
    return digest_index.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the smallest doc_id stays."""
    return parity_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the source targets ask: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the decoded text of every row, as digests."""
    return piece_bpe.piece_query(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("pieces", encoding_stage),
]

#: Random rounding and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself goes when its result, or that of the next one, is written."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before = set(staged_so_far())
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = [path for path in staged_so_far() if path not in before]
            docs = staged(docs, f"pipeline-{name}")
            drop_staged(spark, made)
    return docs
