"""The corpus pipeline: stages over `documents`, each calling one training-data operator.

Each stage takes (spark, docs, sf_dir) and gets all rows that its predecessor kept. All but the last return rows of
`documents` with all their columns; the last returns the packed bins. A null in any column, empty or very long texts,
repeated rows, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geostrata.llm import decontaminate, exact_dedup, packing, quality, similarity
from geostrata.llm.common import remove, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the factorisation machine, fitted on the labelled documents, takes for good and not toxic."""
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")), carry=True)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of the documents with equal bytes."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that similar pairs link."""
    return similarity.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without text of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: The classifier, the similarity join and the local search have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read by the next. Once a stage
    is written, what its predecessor wrote is removed; the last folder stays, as the result is computed from it."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, path = path, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
    return docs
