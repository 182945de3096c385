"""A training corpus from `documents`: language, quality, near-duplicates, then packed windows of token ids.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of documents. The first two judge
each row by its own text where it is, without a shuffle; the third shuffles only what may go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agendum.llm import langid, neardup, packing, quality
from agendum.llm.common import Workspace, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_known_language(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("quality classifier", quality_classifier), ("MinHash near-dedup", minhash_near_dedup), ("packing", pack)]

#: SQL expresses none of the models, so the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are written in the folder that executors share; each is deleted when the next
    one has been written."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs, _ = work.put(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            work.drop(f"stage{k - 1}")
    return docs
