"""The corpus pipeline: documents to packed training sequences.

Each stage takes the table that its predecessor wrote and returns the one that
the next reads; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenmill.llm import decontaminate, language_id, line_chunks, near_dedup, packing
from tokenmill.llm.common import landed, table

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_chunks.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: Language models, signatures and tokenizers are beyond SQL; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
