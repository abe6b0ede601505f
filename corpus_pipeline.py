"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.  All but the last return the columns of
``documents``; the last returns the pieces of the packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detflow.llm.common import read, stage
from detflow.llm.decontamination import drop_contaminated
from detflow.llm.exact_dedup import drop_copies
from detflow.llm.ngram_join import drop_near_copies
from detflow.llm.packing import pack
from detflow.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored 0.5 or more go."""
    return drop_toxic(spark, docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of equal texts stays."""
    return drop_copies(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each linked group stays."""
    return drop_near_copies(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark window go."""
    return drop_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the remaining documents packed into sequences."""
    return pack(spark, docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

# Rows of text that a task and its Python worker hold at once: the stages share their
# executors, and memory that a worker or an Arrow buffer has grown to stays with it.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

ORACLE_SQL = None       # a trained score and a packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, usual = read(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(usual)) if int(usual) > 0 else BATCH_ROWS))
    try:
        for name, apply in STAGES[:-1]:
            docs = stage(spark, apply(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(BATCH, usual)
    return STAGES[-1][1](spark, docs, sf_dir)
