"""Corpus pipeline: the stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import decontaminate, line_dedup, metric_join, packing, pu_quality
from tenure.llm.common import col, others
from tenure.session import stage

#: Words of a shingle and least similarity (percent) of near copies in the corpus. The query
#: of operator 4 has numbers of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, in order, from a result with other texts; ``n_chars`` follows the text."""
    names = set(others(docs, "n_chars"))
    return changed.select(*[col(c) if c in names else F.length("text").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts, unchanged."""
    model = pu_quality.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.score(docs, model).where("predicted = 1").select(*[col(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document has."""
    return _with_text(docs, line_dedup.drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of linked documents, unchanged."""
    return metric_join.drop_near_copies(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with the benchmark; those that are mostly benchmark go."""
    return _with_text(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    return packing.pack(docs)


#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The classifier learns a model, which SQL does not express; tests/llm compares the stages
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
