"""Global ranks without a single-partition window.

Rows are ordered by a 32-bit draw (tie-broken by a key).  The top 12 bits of the
draw pick one of 4096 buckets; bucket sizes are counted (a table of at most
4096 rows per group, so broadcasting it is size-bounded), turned into offsets by
a running sum, and each row's rank is its offset plus its ``row_number`` inside
its (group, bucket) window.  The per-bucket windows spread over the cluster, so
no task ever sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SHIFT = 20  # 32-bit draw >> 20 -> 4096 buckets


def dense_index(df: DataFrame, group_cols: list[str], order_hash: Column, tiebreak: str,
                out: str = "idx", total: str | None = None,
                bounded_groups: bool = True) -> DataFrame:
    """Add ``out`` = 0-based rank of each row inside ``group_cols`` ordered by
    (order_hash, tiebreak); optionally ``total`` = group size.

    ``bounded_groups`` states that the number of groups is small (variants x
    types), so the bucket-offset table is broadcast; otherwise it is joined by
    a regular (AQE-planned) join.
    """
    d = df.withColumn("_h", order_hash).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))
    counts = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    grp = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(grp.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(grp))
    offsets = offsets.drop("_n")
    within = Window.partitionBy(*group_cols, "_b").orderBy("_h", tiebreak)
    d = d.withColumn("_r", F.row_number().over(within))
    d = d.join(F.broadcast(offsets) if bounded_groups else offsets, [*group_cols, "_b"])
    return d.withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("bigint")).drop("_h", "_b", "_r", "_off")


def top_k(df: DataFrame, group_cols: list[str], order_cols: list, k: int, salt_col: str,
          buckets: int = 64) -> DataFrame:
    """Bounded top-k per group in two phases: first per (group, salt bucket),
    then over at most k * buckets survivors per group, so no task sorts a whole
    (possibly huge) group.  Adds ``rank`` (1-based)."""
    salted = df.withColumn("_s", F.abs(F.xxhash64(salt_col)) % buckets)
    w1 = Window.partitionBy(*group_cols, "_s").orderBy(*order_cols)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_s")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
