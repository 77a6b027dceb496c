"""From documents to token ids: quality, language, near copies, benchmark passages, encoding.

Every stage takes the session, the documents that the one before it kept, and the folder of the tables; all but
the last return the columns of documents.  ``run`` writes the result of each stage to the shared folder and
reads it again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tallyglass.functions.store import materialise
from tallyglass.llm import bpe, decontaminate, language, ngram_join, quality
from tallyglass.llm.arrays import give_back
from tallyglass.llm.rows import small_batches


def _lean(stage):
    """The stage in a session of small Arrow batches; the driver gives back the memory that it freed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            give_back()  # models are trained in the driver's process

    return run


STAGES = [(name, _lean(stage)) for name, stage in (
    ("quality", quality.stage),
    ("language", language.stage),
    ("near_copies", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("encoding", bpe.stage),
)]

#: No SQL for trained models; the stages are tested against brute force on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
