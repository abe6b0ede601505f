"""Noun -> determiner-type maps.

A1 is one aggregation keyed by noun with map-side partial aggregation
(``collect_set`` of at most two letters), so a hot noun costs one row per map
task, not one row per occurrence.  The five variants are generated per noun
(no join), and the seeded "keep both for floor(n*share) nouns" choice uses the
bucketed global rank, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detflow.functions.draws import h
from detflow.operators import pairing as D
from detflow.operators.ranking import dense_index
from detflow.sources.tables import VARIANTS


def det_type(det_col) -> F.Column:
    return F.when(F.col(det_col) == "a", F.lit("A")).otherwise(F.lit("B"))


def noun_types_raw(parent: DataFrame, lookahead: int = 4) -> DataFrame:
    """A1: (noun, types ARRAY sorted) over D1 pairs."""
    pairs = D.noun_rows(parent, [], lookahead)
    return pairs.groupBy("noun").agg(*seen(det_type("det"), "A", "B")).select("noun", seen_array("A", "B").alias("types"))


def seen(value, *of: str) -> list[F.Column]:
    """A flag column for each value of a short list: hash aggregation with map-side
    partials, where a collected set sorts all rows of a task."""
    return [F.max(value.eqNullSafe(x)).alias(f"has_{x}") for x in of]


def seen_array(*of: str) -> F.Column:
    """The values whose flags ``seen`` set, in the order given."""
    return F.filter(F.array(*[F.when(F.col(f"has_{x}"), F.lit(x)) for x in of]), lambda x: x.isNotNull())


def with_variants(df: DataFrame, variants=VARIANTS) -> DataFrame:
    """Replicate each row once per variant via a generator (bounded x5)."""
    arr = F.array(*[F.struct(F.lit(m).alias("model_type"), F.lit(float(s)).alias("share")) for m, s in variants])
    return df.select("*", F.explode(arr).alias("_v")).select("*", "_v.model_type", "_v.share").drop("_v")


def kept_both(raw: DataFrame, variants=VARIANTS) -> DataFrame:
    """Per variant, the floor(n*share) two-type nouns with the smallest draw."""
    both = with_variants(raw.where(F.size("types") == 2).select("noun"), variants)
    ranked = dense_index(both, ["model_type"], h("noun", F.lit("keep"), "model_type"), "noun",
                         out="rank", total="n_both")
    return ranked.where(F.col("rank") < F.floor(F.col("n_both") * F.col("share"))).select("model_type", "noun")


def assign_types(raw: DataFrame, variants=VARIANTS) -> DataFrame:
    """A2/A3: (model_type, noun, types) for every variant in one plan.

    Two-type nouns outside the kept set get one type by ``h(noun, model_type) % 2``.
    """
    keep = kept_both(raw, variants).withColumn("_keep", F.lit(True))
    v = with_variants(raw, variants)
    v = v.join(keep, ["model_type", "noun"], "left")
    pick = F.when(h("noun", F.lit("pick"), "model_type") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    types = F.when((F.size("types") == 2) & F.col("_keep").isNull(), F.array(pick)).otherwise(F.col("types"))
    return v.select("model_type", "noun", types.alias("types"))


def exclusive_nouns(noun_types: DataFrame) -> DataFrame:
    """J3 + W5: (model_type, type, noun, idx, n) for nouns with exactly one type;
    idx is dense 0..n-1 per (model_type, type) in draw order."""
    ex = noun_types.where(F.size("types") == 1).select("model_type", F.get(F.col("types"), 0).alias("type"), "noun")
    return dense_index(ex, ["model_type", "type"], h("noun", F.lit("ex"), "model_type"), "noun",
                       out="idx", total="n")


def types_str(c="types") -> F.Column:
    return F.array_join(F.col(c), ",")
