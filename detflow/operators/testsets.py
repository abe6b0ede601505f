"""Test-set selection per variant x age band.

One pass over the child sentences serves all 60 (variant, band) cells: each
sentence's ordered noun candidates are joined to the target nouns (which carry
the first training age), fanned out to the bands where the noun is known, and
the deciding noun is ``min_by(noun, scan order)``.  ``unique_nouns`` keeps the
first sentence per deciding noun in corpus order via ``min`` of the source key,
an aggregate with map-side partials (a hot noun does not land in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detflow.operators import pairing as D
from detflow.operators.bands import limits_from
from detflow.operators.filters import _t
from detflow.operators.joins import join_checked


def child_candidates(child: DataFrame) -> DataFrame:
    """(uid, src, r, noun): for each a/the DET at i and offset 1..2 with a NOUN there;
    r = 2*i + offset is the scan order."""
    t = _t("tagged")

    def at(i):
        def one(off):
            tok = F.get(t, i + off)
            return F.when(D.is_det_tagged(F.get(t, i)) & F.coalesce(tok["pos"] == "NOUN", F.lit(False)),
                          F.struct((i * 2 + off).alias("r"), F.lower(tok["word"]).alias("noun")))
        return F.array(one(1), one(2))

    arr = F.filter(F.flatten(F.transform(D.positions(t), at)), lambda x: x.isNotNull())
    src = F.struct("k", "id", "turn", "sent_no", "uid").alias("src")
    return child.select("uid", src, F.explode(arr).alias("c")).select("uid", "src", "c.*")


def target_nouns(noun_types: DataFrame, train_nouns: DataFrame) -> DataFrame:
    """(model_type, age, noun) unambiguous in the variant and seen in training
    up to the band (equi-join on noun; one row per band where it is known)."""
    unamb = noun_types.where(F.size("types") == 1).select("model_type", "noun")
    return unamb.join(train_nouns, "noun").select("model_type", "age", "noun")


def target_nouns_intersect(noun_types: DataFrame, train_nouns: DataFrame) -> DataFrame:
    """The same set written as an INTERSECT of the two bounded fan-outs."""
    from detflow.operators.assign import with_variants
    from detflow.sources.tables import BAND_LIMITS
    unamb = noun_types.where(F.size("types") == 1).select("model_type", "noun")
    left = unamb.select("model_type", F.explode(F.array(*[F.lit(x) for x in BAND_LIMITS])).alias("age"), "noun")
    right = with_variants(train_nouns).select("model_type", "age", "noun")
    return left.intersect(right)


def _cells(child: DataFrame, noun_types: DataFrame, first_age: DataFrame) -> DataFrame:
    """(uid, src, model_type, noun, ages): the deciding nouns of each child sentence per
    variant, each with the ages at which it decides.  A candidate meets its noun once for all
    variants, and a sentence is one group; cells are made inside it."""
    cand = child_candidates(child)
    tgt = noun_types.where(F.size("types") == 1).groupBy("noun").agg(F.collect_set("model_type").alias("variants")).join(first_age, "noun")
    x = join_checked(cand, tgt, "noun").select("uid", "src", F.struct("r", "noun", "variants", "min_age").alias("c"))
    x = x.groupBy("uid").agg(F.min("src").alias("src"), F.sort_array(F.collect_list("c")).alias("c"))
    x = x.select("uid", "src", "c", F.explode(F.array_distinct(F.flatten(F.col("c.variants")))).alias("model_type"))
    x = x.withColumn("c", F.filter("c", lambda c: F.array_contains(c["variants"], F.col("model_type"))))
    # in scan order a candidate decides at the ages from its own up to those that an earlier one has
    reach = lambda i: F.array_min(F.transform(F.slice("c", F.lit(1), i), lambda b: b["min_age"]))
    own = F.transform("c", lambda c, i: F.struct(c["noun"].alias("noun"), F.filter(
        limits_from(c["min_age"]), lambda age: (i == 0) | F.coalesce(age < reach(i), F.lit(True))).alias("ages")))
    x = x.select("uid", "src", "model_type", F.explode(own).alias("own")).where(F.size("own.ages") > 0)
    return x.select("uid", "src", "model_type", "own.*")


def deciding(child: DataFrame, noun_types: DataFrame, first_age: DataFrame) -> DataFrame:
    """(model_type, age, uid, noun, src): the deciding noun of each child sentence
    per cell; ``first_age`` is (noun, min_age) of the training side (A9)."""
    return _cells(child, noun_types, first_age).select("model_type", F.explode("ages").alias("age"), "uid", "noun", "src")


def make_test_sets(child: DataFrame, noun_types: DataFrame, first_age: DataFrame,
                   unique_nouns: bool = True, columns: list[str] | None = None) -> DataFrame:
    """(model_type, age, uid, noun) + the child sentence columns (``columns``; default: all)."""
    if unique_nouns:
        cells = _cells(child, noun_types, first_age).groupBy("model_type", "noun", "ages").agg(F.min("src").alias("src"))
        dec = cells.select("model_type", "noun", "src", F.explode("ages").alias("age")).groupBy(
            "model_type", "age", "noun").agg(F.min("src").alias("src")) \
            .select("model_type", "age", "noun", F.col("src.uid").alias("uid"))
    else:
        dec = deciding(child, noun_types, first_age).drop("src")
    return dec.join(child.select(*columns) if columns else child, "uid")
