"""The training-corpus pipeline: quality rules, near-duplicate removal, repeated passages, mixing, byte-level BPE.

Every stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet in the folder that the cluster shares
and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import bpe, common, mixing, near_dedup, passages, quality
from specloom.session import ready

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def readied(stage: Stage) -> Stage:
    """A stage that can be called by itself: the session is made ready first."""
    return lambda spark, docs, sf_dir: stage(ready(spark), docs, sf_dir)


STAGES = [
    ("quality_rules", readied(quality.stage)),
    ("near_dedup", readied(near_dedup.stage)),
    ("substring_dedup", readied(passages.stage)),
    ("mixing", readied(mixing.stage)),
    ("byte_bpe", readied(bpe.stage)),
]

#: No SQL expresses the suffix arrays, sketches and merges of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
