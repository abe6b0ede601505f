"""Children vs model: flexible determiner use and the final-band confusion
matrix (R9, R11, A11-A15, T11, T13, J9, J10, P17, P18, U2).

Flexible use counts, per (age, subject), the nouns seen with both "a" and "the"
(D6 pairs); per age it reports the median and nearest-index quartiles over the
subjects.  Groups are (age, subject) -- bounded by the number of subjects -- and
every aggregate is a plain grouped aggregate or a window over one age's
subjects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.tagger import tag_tokens
from detflow.operators import filters as P
from detflow.operators import pairing as D
from detflow.operators.predict import mask_context, predict
from detflow.sources.tables import BAND_LIMITS, UNFILTERED

FINAL_BAND = 58
LABELS = ["a", "other", "the"]


def overall_eval_set(normalized: DataFrame) -> DataFrame:
    """Normalised utterances, tagged, kept when DET (+X) + NOUN.
    (Pipelines materialise the tagged table before this filter; see StudyPlan.)"""
    t = normalized.withColumn("tagged", tag_tokens(T.tokens("utt")))
    return t.where(P.any_det_x_noun("tagged"))


def noun_dets(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, noun, dets): determiners seen per noun via D6 pairs."""
    p = D.explode_pairs(df, D.pair_flex("tagged"), keys)
    return p.groupBy(*keys, "noun").agg(F.collect_set("det").alias("dets"))


def flexible_use_counts(df: DataFrame, keys=("age_months", "subject")) -> DataFrame:
    """A11 + U2: per group, nouns whose determiner set contains {a, the};
    groups without such nouns count 0."""
    keys = list(keys)
    nd = noun_dets(df, keys)
    both = nd.where(F.size(F.array_except(F.array(F.lit("a"), F.lit("the")), F.col("dets"))) == 0)
    cnt = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_flex"))
    groups = df.select(*keys).distinct()
    return groups.join(cnt, keys, "left").fillna(0, subset=["n_flex"])


def at_rank(histogram, rank):
    """The value at a rank (from 0) of a sorted array of (value, upto): ``upto`` counts
    the rows of this and smaller values."""
    return F.get(F.filter(histogram, lambda x: x["upto"] > rank), 0)["value"]


def flexible_use_iqr(counts: DataFrame) -> DataFrame:
    """Per age the median and the quartiles sorted[n//4], sorted[3n//4]
    (nearest index, not interpolated) of the per-subject counts.

    The rows of an age are never sorted or brought together: equal values are
    counted with map-side partials, and a rank is looked up in the age's
    histogram, which is as long as it has distinct values."""
    values = counts.groupBy("age_months", "n_flex").agg(F.count(F.lit(1)).alias("c"))
    h = values.groupBy("age_months").agg(F.sort_array(F.collect_list(F.struct(F.col("n_flex").alias("value"), "c"))).alias("h"),
                                         F.sum("c").alias("n"))
    upto = F.aggregate("h", F.array().cast("array<struct<value:bigint,upto:bigint>>"), lambda acc, x: F.concat(acc, F.array(F.struct(
        x["value"].alias("value"), (x["c"] + F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0))).alias("upto")))))
    h = h.withColumn("h", upto)
    n, x = F.col("n"), F.col("h")
    half = (at_rank(x, F.floor((n - 1) / 2)) + at_rank(x, F.floor(n / 2))) / F.lit(2.0)
    return h.select("age_months", half.alias("median"), at_rank(x, F.floor(n / 4)).alias("q1"), at_rank(x, F.floor(n * 3 / 4)).alias("q3"))


def mask_single_det(df: DataFrame) -> DataFrame:
    """P15 + T11: sentences with exactly one a/the token; gold determiner, masked
    sentence, the target noun (next token if NOUN) and the mask context."""
    t = df.where(P.one_det_only("tagged"))
    idx = F.array_position(F.transform("tagged", lambda x: D.is_det_word(x)), True) - 1
    t = t.withColumn("det_idx", idx.cast("int"))
    tg = F.col("tagged")
    nxt = F.get(tg, F.col("det_idx") + 1)
    prev, after = mask_context(tg, F.col("det_idx"))
    masked = F.array_join(F.transform(tg, lambda x, i: F.when(i == F.col("det_idx"), F.lit("[MASK]"))
                                      .otherwise(x["word"])), " ")
    return t.select("*", F.lower(F.get(tg, F.col("det_idx"))["word"]).alias("gold_det"),
                    masked.alias("masked"),
                    F.when(nxt["pos"] == "NOUN", F.lower(nxt["word"])).alias("noun"),
                    prev.alias("prev"), after.alias("next"))


def _of_model(df: DataFrame, model_type: int) -> DataFrame:
    return df.withColumn("age", F.col("age_months").cast("int")).withColumn("model_type", F.lit(model_type))


def model_availability(df: DataFrame, model_type: int = UNFILTERED, registry: DataFrame | None = None) -> DataFrame:
    """The model of an age group is (model_type, int(age)); groups without a
    trained band are skipped.  ``registry``: the trained bands (``discover_bands``);
    without one, every band limit of the study counts as trained."""
    a = _of_model(df, model_type)
    if registry is None:
        return a.where(F.array_contains(F.array(*[F.lit(x) for x in BAND_LIMITS]), F.col("age")))
    trained = registry.where(F.col("model_type") == model_type).select("age")
    return a.join(F.broadcast(trained), "age", "left_semi").select(a.columns)   # one row per directory of the model


def skipped_ages(df: DataFrame, registry: DataFrame, model_type: int = UNFILTERED) -> DataFrame:
    """(model_type, age, n_sentences) of the age groups without a trained band;
    sentences without an age are the group of age null."""
    groups = _of_model(df, model_type).groupBy("model_type", "age").agg(F.count(F.lit(1)).alias("n_sentences"))
    return groups.join(registry.select("model_type", "age"), ["model_type", "age"], "left_anti")


def replace_det(tagged, new_det) -> F.Column:
    """The first a/the token (any POS) becomes ``new_det``; POS kept."""
    t = F.col(tagged) if isinstance(tagged, str) else tagged
    first = F.array_position(F.transform(t, lambda x: D.is_det_word(x)), True) - 1
    return F.transform(t, lambda x, i: F.when(i == first, F.struct(new_det.alias("word"), x["pos"].alias("pos")))
                       .otherwise(x))


def model_predictions(overall: DataFrame, tri: DataFrame, model_type: int = UNFILTERED, cut=None,
                      registry: DataFrame | None = None) -> DataFrame:
    """R7 on the age-aligned model; J10: predictions stay keyed by uid.  ``tri``:
    the model's training triples; ``registry``: its trained bands."""
    q = model_availability(mask_single_det(overall), model_type, registry)
    return predict(q, tri, [model_type], cut)


def flexible_use_model(preds: DataFrame) -> DataFrame:
    """P17 -> T13 -> A11 on the sentences with the predicted determiner."""
    p = preds.where(F.col("pred_det").isin("a", "the"))
    p = p.withColumn("tagged", replace_det("tagged", F.col("pred_det")))
    return flexible_use_counts(p)


def evaluate_overall(overall: DataFrame, tri: DataFrame, model_type: int = UNFILTERED) -> DataFrame:
    """Per age, child and model median / q1 / q3 of flexible use."""
    child = flexible_use_iqr(flexible_use_counts(overall))
    model = flexible_use_iqr(flexible_use_model(model_predictions(overall, tri, model_type)))
    c = child.select("age_months", *[F.col(x).alias(f"child_{x}") for x in ("median", "q1", "q3")])
    m = model.select("age_months", *[F.col(x).alias(f"model_{x}") for x in ("median", "q1", "q3")])
    return c.join(m, "age_months", "left")


def final_band_predictions(overall: DataFrame, tri: DataFrame, model_type: int = UNFILTERED, cut=None) -> DataFrame:
    """P12 + T11 + R7 with the final-band model, then P18."""
    q = mask_single_det(overall.where(F.col("age_months") <= FINAL_BAND))
    q = q.withColumn("age", F.lit(FINAL_BAND)).withColumn("model_type", F.lit(model_type))
    p = predict(q, tri, [model_type], cut)
    return p.where(F.col("gold_det").isin("a", "the") & F.col("pred_det").isin(*LABELS))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """3 x 3 over (a, other, the), rows gold, columns predicted, each cell
    divided by the grand total."""
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"))
                                for g in LABELS for p in LABELS]))
    grid = preds.sparkSession.range(1).select(cells.alias("c")).select("c.*")
    c = preds.groupBy(F.col("gold_det").alias("gold"), F.col("pred_det").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    out = grid.join(c, ["gold", "pred"], "left").fillna(0, subset=["n"])
    tot = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("share", F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0)))


def accuracy_coverage(preds: DataFrame) -> DataFrame:
    """A15."""
    return preds.agg(
        F.avg((F.col("gold_det") == F.col("pred_det")).cast("double")).alias("accuracy"),
        F.avg(F.col("pred_det").isin("a", "the").cast("double")).alias("coverage"),
        F.count(F.lit(1)).alias("n"))
