"""A corpus from raw documents: what is toxic, copied or leaked goes; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bequest.llm.common import kept, table
from bequest.llm.decontaminate import without_leaks
from bequest.llm.exact_dedup import without_copies
from bequest.llm.ngram_join import without_near_copies
from bequest.llm.packing import best_fit_packing, measured
from bequest.llm.toxicity import fit, scored

#: Score from which a document is toxic, and words of a training sequence.
TOXIC = 0.7
SEQUENCE = 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored(docs, model, TOXIC).filter("predicted = 0").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, k=5, num=80, den=100).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(measured(docs), SEQUENCE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# Scores of a fitted model, sets of shingles and packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
