"""Training corpora per variant and age band.

Bins are assigned with a CASE built from the band edges (no join); cumulative
"age <= limit" views are generated per row with ``filter(limits, l -> l >= age)``
(at most 12 copies), never by rescanning the table per limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detflow.operators import editlog as EL
from detflow.operators import pairing as D
from detflow.operators.assign import seen, seen_array
from detflow.operators.ranking import top_k
from detflow.sources.tables import BAND_EDGES, BAND_LIMITS


def band_of(age: Column) -> Column:
    """Hi of the single bin (lo, hi] holding ``age``; NULL outside (0, 58]."""
    expr = None
    for lo, hi in zip(BAND_EDGES[:-1], BAND_EDGES[1:]):
        cond = (age > lo) & (age <= hi)
        expr = F.when(cond, F.lit(hi)) if expr is None else expr.when(cond, F.lit(hi))
    return expr


def limits_from(age: Column) -> Column:
    """Every band limit L with age <= L (cumulative views)."""
    return F.filter(F.array(*[F.lit(x) for x in BAND_LIMITS]), lambda l: l >= age)


def training_corpus(parent: DataFrame, log: DataFrame, variants: list[int] = EL.EVERY) -> DataFrame:
    """Rewritten parent text for variants 0-75 plus the raw parent text as
    variant 100; (model_type, uid, k, id, turn, sent_no, age_months, utt, tagged),
    where ``tagged`` equals tagging ``utt`` afresh.  ``log`` has no rows of
    variant 100, so its sentences stay as they are."""
    cols = ["model_type", "uid", "k", "id", "turn", "sent_no", "age_months", "utt", "tagged"]
    return EL.texts(parent, log, variants).where(F.trim("utt") != "").select(*cols)


def in_bands(df: DataFrame) -> DataFrame:
    """One bin per sentence; rows outside (0, 58] are dropped."""
    return df.withColumn("band_hi", band_of(F.col("age_months"))).where(F.col("band_hi").isNotNull())


def noun_det_sets(base: DataFrame, log: DataFrame, lookahead: int = 4) -> DataFrame:
    """A4: determiners seen per noun (D2) per variant and band, counted by
    difference.  ``base``: the sentences with ``band_hi``."""
    signed = EL.signed_pairs(base, log, lambda t: D.pair_checking(t, lookahead))
    n = EL.count_by(signed, ["band_hi", "noun", "det"])
    keys = ["model_type", "band_hi", "noun"]
    return n.groupBy(*keys).agg(*seen(F.col("det"), "a", "the")).select(*keys, seen_array("a", "the").alias("dets"))


def usage_summary(sets: DataFrame, examples: int = 10) -> DataFrame:
    """A5 (+W6): per (model_type, band_hi) counts of nouns seen with only a,
    only the, both, and the first ``examples`` nouns of each (noun order)."""
    has_a = F.array_contains("dets", "a")
    has_the = F.array_contains("dets", "the")
    cat = F.when(has_a & has_the, "both").when(has_a, "only_a").when(has_the, "only_the")
    s = sets.withColumn("category", cat)
    keys = ["model_type", "band_hi"]
    counts = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("category") == "only_a").alias("only_a"),
        F.count_if(F.col("category") == "only_the").alias("only_the"),
        F.count_if(F.col("category") == "both").alias("both"))
    first = top_k(s, [*keys, "category"], ["noun"], examples + 1, "noun")
    ex = first.groupBy(*keys, "category").agg(
        F.sort_array(F.collect_list(F.struct("rank", "noun"))).alias("_l"))
    ex = ex.withColumn("examples", F.concat(
        F.array_join(F.transform(F.slice("_l", 1, examples), lambda x: x["noun"]), ", "),
        F.when(F.size("_l") > examples, F.lit("...")).otherwise(F.lit(""))))
    piv = ex.groupBy(*keys).agg(*[
        F.max(F.when(F.col("category") == c, F.col("examples"))).alias(f"ex_{c}")
        for c in ("only_a", "only_the", "both")])
    return counts.join(piv, keys, "left")


def first_training_age(parent: DataFrame) -> DataFrame:
    """(noun, min_age): youngest parent row where the noun follows a/the."""
    p = D.noun_rows(parent, ["age_months"], 2)
    return p.groupBy("noun").agg(F.min("age_months").alias("min_age"))


def training_nouns_by_band(parent: DataFrame) -> DataFrame:
    """(age, noun): nouns seen after a/the (D4) in parent rows with age <= limit."""
    first = first_training_age(parent)
    return first.select(F.explode(limits_from(F.col("min_age"))).alias("age"), "noun")
