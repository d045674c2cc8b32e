"""From raw documents to packed training sequences: five operators of millrace.llm, one after the other.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents.

Defined results: a null or empty text, or one of fewer than 20 words, fails the base rules of the first
stage. Equal rows are one group of copies, so one of them is left by the third; of a group the row of the
least doc_id stays, and of equal doc_ids that of the least text hash. A null doc_id is a document like any
other. Without labels no document is rejected by the classifier beyond what the share of good labels (a
half) says, and the rules compare the corpus with itself. Without benchmark items nothing is contaminated.
Without documents every stage returns no row. Extra columns pass through the first four stages. Texts may
have any length; in the last they are cut into runs of 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard_join, packing, quality_knn, quality_rules
from millrace.llm.queries import id_remainder
from millrace.session import release, table, workers_import, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are unlike the trusted ones, go."""
    return quality_rules.without_rejected(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose labelled neighbours are mostly bad go. The labels are learnt on the whole table, where bad documents still are."""
    workers_import(spark)
    model = quality_knn.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(id_remainder(5) != 0))
    return quality_knn.without_rejected(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id."""
    workers_import(spark)
    return jaccard_join.without_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of words with a benchmark item go."""
    workers_import(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each run of tokens lies in the training sequences."""
    workers_import(spark)
    return packing.pack(packing.runs(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", pack),
]

#: Nearest neighbours and packing have no SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
