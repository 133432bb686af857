"""A training-corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import stored, table
from palimpsest.llm.decontaminate import decontamination_stage
from palimpsest.llm.ngram_join import near_duplicate_stage
from palimpsest.llm.packing import packing_stage
from palimpsest.llm.quality import quality_stage
from palimpsest.llm.substring_dedup import substring_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

# Fitted models, token ids and alignments are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
