"""A bounded sample of labelled rows, and its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import stage


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def training_texts(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int,
                   bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows outside the held-out
    fold: those of the smallest id hashes.  The ids, at most ``bound``, are
    broadcast to the scan of the texts.  An id that several rows hold counts
    once, with its text of the smallest hash, so it weighs as any other and the
    bound holds for the rows."""
    wanted = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("l_id").isNotNull()).where(F.coalesce(
            fold("l_id", modulus) != held_out, F.lit(False)))
    wanted = wanted.dropDuplicates(["l_id"]).orderBy(F.xxhash64("l_id"), "l_id").limit(bound)
    wanted = stage(spark, wanted, "labelled-ids")
    rows = (docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(wanted), "l_id"))
    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text"))
    return rows.groupBy("l_id", "label").agg(least.alias("least")).select("least.text", "label")
