"""Corpus pipeline: each stage works on the table its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm import stages
from cartwise.llm.common import stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_repeated_lines),
    ("near dedup", stages.drop_near_copies),
    ("pii", stages.mask_personal_data),
    ("packing", stages.pack),
]

#: A model, MinHash and a tokenizer cannot be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
