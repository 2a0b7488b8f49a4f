"""The corpus pipeline: each stage reads what the one before it wrote.

toxicity -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> packing. All stages but
the last return the columns of the documents they keep; each is judged on all its input's rows.
A stage's scratch tables are dropped when the next stage begins: by then its result has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import grace_dedup, ngram_join, packing, spaced_seed, toxicity
from sightline.llm.common import materialize, release, scratch_scope, table

SCOPE = "pipeline"


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, SCOPE)
        with scratch_scope(SCOPE):
            return run(spark, docs, sf_dir)

    return stage


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace_dedup.drop_exact_duplicates(docs)


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seed.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", dedup_exact), ("ngram_jaccard_join", dedup_near), ("benchmark_decontamination", decontaminate), ("packing", pack)]
#: Scores, tokens and fuzzy overlaps are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        with scratch_scope("pipeline-stages"):
            docs = materialize(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
