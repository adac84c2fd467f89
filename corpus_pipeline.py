"""The corpus pipeline: quality rules, quality classifier, near-copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofkit.llm import classifier, minhash, packing, rules, suffix
from asofkit.llm.common import table, written

#: (name, function of spark, docs, sf_dir); each but the last returns the columns of documents.
STAGES = [
    ("quality_rules", rules.stage),
    ("quality_classifier", classifier.stage),
    ("minhash_near_dedup", minhash.stage),
    ("suffix_array_dedup", suffix.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL cannot express the sketches, the network and the packing; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
