"""A corpus pipeline of this library's operators: STAGES in order, each (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of documents, without the rows that they reject; the last packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramix.llm import bestfit, decontaminate, language, ngram_jaccard, quality
from engramix.llm.work import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more by a model fitted on the labelled rows of docs."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the profiles know; texts without letters or unlike all of them go."""
    return language.keep_known(docs, language.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id."""
    return ngram_jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their sequences and offsets."""
    return bestfit.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Trained models, component search and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
