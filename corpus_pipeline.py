"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.io import table
from quillon.llm import classifier, near_dedup, packing, quality_rules
from quillon.llm.common import staged
from quillon.llm.queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules on their own text or are depleted of lines that their host repeats; takes these lines out of the others."""
    return quality_rules.keep_good(docs, max_docs=quality_rules.MAX_DOCS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold; learns from the labelled rows among its own input."""
    return classifier.keep_good(docs, classifier.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near copies."""
    return near_dedup.keep_one(docs)


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

#: SQL can express neither the fitted classifier nor ICWS and packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
