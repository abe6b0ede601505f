"""Joins of a table that grows with the corpus with a lookup side.

``join_checked`` broadcasts the lookup side only after its row count has been
measured to be under a bound; above the bound it is ``salted_join``, a shuffle
join in which no key fills a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000
MOST_HOT_KEYS = 1_000        # keys in the sketch's answer; the list of hot keys is no longer
TRACKED_PER_KEY = 10         # items that the sketch tracks for each key asked for


def hot_keys(df: DataFrame, on: list[str], partitions: int) -> DataFrame:
    """(_key, _salts) of the keys that hold more than one in ``partitions`` of the
    rows of ``df``, by a mergeable frequent-items sketch over key hashes; ``_salts``
    is the number of even partitions that such a key fills.  Lazy, and never more
    than MOST_HOT_KEYS rows."""
    k = min(max(partitions, 1), MOST_HOT_KEYS)
    top = df.select(F.xxhash64(*on).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {k}, {k * TRACKED_PER_KEY})").alias("top"), F.count(F.lit(1)).alias("n"))
    return (top.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * k > F.col("n"))
            .select(F.col("t.item").alias("_key"), F.ceil(F.col("t.count") * k / F.col("n")).alias("_salts")))


def salted_join(big: DataFrame, small: DataFrame, on, how: str = "inner", spread: list[str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """Sort-merge join on ``on`` (inner, left, left_semi or left_anti) in which the
    rows of ``big`` with a hot key are dealt out by a salt and only the rows of
    ``small`` with such a key are repeated, once a salt.

    ``spread``: columns of ``big`` that tell rows with one key apart (default: all;
    rows equal in all columns then share a salt).  The salt is a hash of row values,
    so a repeated task makes the same one.  Null keys meet nothing, as in any join,
    and are dealt out like other hot keys.  ``big`` is read twice, for the sketch
    and for the join: pass a written stage.  Keys must have one type on both sides."""
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't repeat rows of the lookup side")
    for c in on:
        one, other = (df.schema[c].dataType for df in (big, small))
        if one != other or one.simpleString() in ("float", "double"):
            raise ValueError(f"{c}: {one.simpleString()} and {other.simpleString()} don't hash alike")
    n = partitions or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(big, on, n))                     # bounded by MOST_HOT_KEYS
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    of_row = F.xxhash64(*(spread or big.columns))
    dealt = big.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").withColumn(
        "_salt", F.pmod(of_row, salts)).drop("_key", "_salts")
    repeated = small.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_key", "_salts")
    return dealt.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)
