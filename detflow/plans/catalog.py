"""Registered queries: key -> fn(spark, sf_dir) -> DataFrame.

``Corpus``) so its work grows with them.  Computed columns carry the same names
as the DuckDB oracle in ``oracle/queries.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from detflow.functions import text as T
from detflow.operators import clean as C
from detflow.operators import decode as DC
from detflow.operators import pairing as D
from detflow.operators.joins import salted_join
from detflow.plans.study import StudyPlan
from detflow.sources.tables import Corpus, indexed_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def _n_names(c: Corpus) -> int:
    # The names dimension is a bounded lookup table (one row per name).
    return c.table("nation").count()


# ---------------------------------------------------------------- sources
@query("src_corpus")
def q_src_corpus(spark, d):
    """The wide corpus as the headed CSV it comes in, read back by the CSV reader."""
    wide, path = C.wide_corpus(Corpus(spark, d).raw_corpus), _out_dir(spark, "corpus")
    IO.write_corpus_csv(wide, path, F.xxhash64("uid"))
    return IO.read_corpus_csv(spark, path, Ty.StructType([Ty.StructField("_index", Ty.LongType()), *wide.schema.fields]))


@query("src_names")
def q_src_names(spark, d):
    """Names from their CSV, with the dense index."""
    path = _out_dir(spark, "names")
    IO.write_names(Corpus(spark, d).table("nation").select(F.col("n_name").alias("name")), path)
    return indexed_names(IO.read_names(spark, path)).select("idx", "name")


@query("decode_tagged")
def q_decode_tagged(spark, d):
    c = Corpus(spark, d)
    enc = c.tagged.select("uid", F.to_json("tagged").alias("tagged_json"))
    dec = enc.select("uid", F.coalesce(
        F.from_json("tagged_json", "array<struct<word:string,pos:string>>", {"mode": "PERMISSIVE"}),
        F.array().cast("array<struct<word:string,pos:string>>")).alias("tagged"))
    return dec.select("uid", F.size("tagged").alias("n_tok"), T.words("tagged").alias("words"),
                      F.array_join(F.transform("tagged", lambda x: x["pos"]), " ").alias("tags"))


# ---------------------------------------------------------------- cleaning
def _wide(spark, d):
    return C.wide_corpus(Corpus(spark, d).raw_corpus)


@query("drop_null_utts")
def q_drop_null(spark, d):
    return C.drop_null_utts(_wide(spark, d), "p_utts").select("uid", "p_utts")


@query("drop_only_mask")
def q_drop_only_mask(spark, d):
    return C.drop_only_mask(C.drop_null_utts(_wide(spark, d), "p_utts"), "p_utts").select("uid", "p_utts")


@query("split_speakers")
def q_split_speakers(spark, d):
    return C.split_speakers(_wide(spark, d)).select("uid", "speaker", "utt")


@query("norm_article")
def q_norm_article(spark, d):
    return Corpus(spark, d).raw_corpus.select("uid", T.norm_article("utt").alias("utt"))


@query("strip_at")
def q_strip_at(spark, d):
    return Corpus(spark, d).raw_corpus.select("uid", T.strip_at("utt").alias("utt"))


@query("clean_entities")
def q_clean_entities(spark, d):
    return Corpus(spark, d).raw_corpus.select("uid", T.clean_entities("utt").alias("utt"))


@query("import_clean")
def q_import_clean(spark, d):
    return C.import_clean(_wide(spark, d)).select("uid", "speaker", "utt", "age_months")


@query("rename_select")
def q_rename_select(spark, d):
    ic = C.import_clean(_wide(spark, d))
    return ic.where(F.col("speaker") == "child").select("uid", "subject", "age_months", "utt")


@query("pick_utt_column")
def q_pick_utt(spark, d):
    return _wide(spark, d).select("uid", F.coalesce("p_utts", "c_utts").alias("utt"))


def normalized(spark, d) -> DataFrame:
    return StudyPlan.shared(spark, d).normalized


@query("drop_empty")
def q_drop_empty(spark, d):
    n = normalized(spark, d)
    return C.drop_empty(n.where(F.col("speaker") == "parent")).select("uid", "utt")


@query("age_range")
def q_age_range(spark, d):
    p = Corpus(spark, d).parent
    return p.where((F.col("age_months") > 14) & (F.col("age_months") <= 30)).select("uid", "age_months")


@query("age_upto")
def q_age_upto(spark, d):
    p = Corpus(spark, d).parent
    return p.where(F.col("age_months") <= 30).select("uid", "age_months")


# ---------------------------------------------------------------- tokens
@query("tokenize")
def q_tokenize(spark, d):
    u = Corpus(spark, d).utterances.withColumn("_t", T.tokens("utt"))
    return u.select("uid", F.size("_t").alias("n_tok"), F.array_join("_t", " ").alias("tokens"))


@query("lemmatize")
def q_lemmatize(spark, d):
    u = Corpus(spark, d).utterances
    return u.select("uid", F.array_join(C.lemmatize(T.tokens("utt")), " ").alias("lemmas"))


def _cleaned_tokens(spark, d):
    ic = C.import_clean(_wide(spark, d))
    return ic.select("uid", T.tokens_with_markers("utt").alias("tok"))


@query("expand_repeats")
def q_expand_repeats(spark, d):
    t = _cleaned_tokens(spark, d)
    return t.select("uid", F.array_join(T.expand_repeats("tok"), " ").alias("expanded"))


@query("strip_plus_join")
def q_strip_plus_join(spark, d):
    t = _cleaned_tokens(spark, d)
    return t.select("uid", T.strip_plus_join("tok").alias("utt"))


@query("replace_mask_names")
def q_replace_mask_names(spark, d):
    c = Corpus(spark, d)
    rc = C.drop_only_mask(c.raw_corpus.select("uid", "utt"))
    return C.replace_mask_names(rc, "utt", c.names, _n_names(c)).select("uid", "utt")


@query("replace_at_names")
def q_replace_at_names(spark, d):
    c = Corpus(spark, d)
    return C.replace_at_names(c.raw_corpus.select("uid", "utt"), "utt", c.names, _n_names(c)).select("uid", "utt")


@query("normalize_utts")
def q_normalize(spark, d):
    return normalized(spark, d).select("uid", "speaker", "subject", "age_months", "utt")


@query("pos_tag")
def q_pos_tag(spark, d):
    t = Corpus(spark, d).tagged
    return t.select("uid", F.array_join(F.transform("tagged", lambda x: x["pos"]), " ").alias("tags"))


@query("learn_tag_lexicon")
def q_learn_tag_lexicon(spark, d):
    t = Corpus(spark, d).parent.select(F.explode("tagged").alias("x"))
    c = t.groupBy(F.lower("x.word").alias("word"), F.col("x.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("word").agg(F.max_by("pos", F.struct("n", "pos")).alias("pos"),
                                 F.sum("n").alias("n"))


@query("tag_transitions")
def q_tag_transitions(spark, d):
    return DC.transition_counts(Corpus(spark, d).parent)


@query("tag_decode")
def q_tag_decode(spark, d):
    # the model and the decoder read the sentences five times: tagged and written once
    tagged = StudyPlan.shared(spark, d).stages.write(
        Corpus(spark, d).tagged.select("uid", "role", "age_months", "tagged"), "corpus_tagged")
    paths = DC.decode(tagged, tagged.where((F.col("role") == "assistant") & F.col("age_months").isNotNull()))
    return paths.select("uid", F.array_join("path", " ").alias("tags"), "score")


@query("words_join")
def q_words_join(spark, d):
    return Corpus(spark, d).tagged.select("uid", T.words("tagged").alias("utt"))


# ---------------------------------------------------------------- pairing
def _pairs(df: DataFrame, expr) -> DataFrame:
    return D.explode_pairs(df, expr, ["uid"])


@query("pair_assign")
def q_pair_assign(spark, d):
    return _pairs(Corpus(spark, d).parent, D.pair_assign("tagged"))


@query("pair_checking")
def q_pair_checking(spark, d):
    return _pairs(Corpus(spark, d).parent, D.pair_checking("tagged"))


@query("pair_unbounded")
def q_pair_unbounded(spark, d):
    return _pairs(Corpus(spark, d).parent, D.pair_unbounded("tagged"))


@query("pair_train2")
def q_pair_train2(spark, d):
    return _pairs(Corpus(spark, d).parent, D.pair_train2("tagged"))


@query("pair_eval")
def q_pair_eval(spark, d):
    return _pairs(Corpus(spark, d).child, D.pair_eval("tagged"))


@query("pair_flex")
def q_pair_flex(spark, d):
    t = Corpus(spark, d).tagged.where(F.col("age_months").isNotNull() & F.col("role").isin("user", "assistant"))
    return _pairs(t, D.pair_flex("tagged"))


# ---------------------------------------------------------------- filters
from detflow.operators import assign as A  # noqa: E402
from detflow.operators import filters as P  # noqa: E402
from detflow.operators import rewrite as R  # noqa: E402


@query("filter_det_noun")
def q_filter_det_noun(spark, d):
    return StudyPlan.shared(spark, d).child.where(P.det_noun("tagged")).select("uid", "utt")


@query("filter_any_det_x_noun")
def q_filter_any(spark, d):
    return StudyPlan.shared(spark, d).child.where(P.any_det_x_noun("tagged")).select("uid", "utt")


@query("one_det_only")
def q_one_det_only(spark, d):
    return StudyPlan.shared(spark, d).child.where(P.one_det_only("tagged")).select("uid", "utt")


@query("one_candidate")
def q_one_candidate(spark, d):
    c = StudyPlan.shared(spark, d).child.where(P.one_candidate("tagged"))
    return _pairs(c, D.pair_eval("tagged")).select("uid", "det_idx", "noun")


# ---------------------------------------------------------------- assignment
def raw_types(spark, d):
    return StudyPlan.shared(spark, d).raw_types


def noun_types(spark, d):
    return StudyPlan.shared(spark, d).noun_types


@query("noun_types_raw")
def q_noun_types_raw(spark, d):
    return raw_types(spark, d).select("noun", A.types_str().alias("types"))


@query("assign_types")
def q_assign_types(spark, d):
    nt = A.assign_types(raw_types(spark, d), [(25, 0.25)])
    return nt.select("noun", A.types_str().alias("types"))


@query("assign_all_variants")
def q_assign_all(spark, d):
    return noun_types(spark, d).select("model_type", "noun", A.types_str().alias("types"))


@query("pick_share")
def q_pick_share(spark, d):
    return A.kept_both(raw_types(spark, d))


@query("dense_index")
def q_dense_index(spark, d):
    return A.exclusive_nouns(noun_types(spark, d)).select("model_type", "type", "noun", "idx")


@query("invert_types")
def q_invert_types(spark, d):
    nt = noun_types(spark, d)
    return nt.where(F.size("types") == 1).select("model_type", F.get(F.col("types"), 0).alias("type"), "noun")


@query("set_difference")
def q_set_difference(spark, d):
    raw = raw_types(spark, d)
    both = A.with_variants(raw.where(F.size("types") == 2).select("noun")).select("model_type", "noun")
    return both.join(A.kept_both(raw), ["model_type", "noun"], "left_anti")


@query("exclusive_sets")
def q_exclusive_sets(spark, d):
    nt = noun_types(spark, d)
    cat = F.when(F.size("types") == 2, "both").otherwise(F.get(F.col("types"), 0))
    return nt.groupBy("model_type", cat.alias("category")).agg(F.count(F.lit(1)).alias("n_nouns"))


@query("noun_det_counts")
def q_noun_det_counts(spark, d):
    pr = _pairs(Corpus(spark, d).parent, D.pair_unbounded("tagged"))
    return pr.groupBy("noun").agg(F.count_if(F.col("det") == "a").alias("n_a"),
                                  F.count_if(F.col("det") == "the").alias("n_the"))


@query("noun_det_partition")
def q_noun_det_partition(spark, d):
    c = q_noun_det_counts(spark, d)
    return c.agg(F.count_if((F.col("n_a") > 0) & (F.col("n_the") > 0)).alias("both_count"),
                 F.count_if((F.col("n_a") > 0) & (F.col("n_the") == 0)).alias("only_a_count"),
                 F.count_if((F.col("n_a") == 0) & (F.col("n_the") > 0)).alias("only_the_count"))


@query("nouns_with_both")
def q_nouns_with_both(spark, d):
    """The nouns behind ``both_count`` of A7, with their counts."""
    return q_noun_det_counts(spark, d).where("n_a > 0 AND n_the > 0")


@query("distinct_nouns")
def q_distinct_nouns(spark, d):
    t = Corpus(spark, d).parent.select(F.explode("tagged").alias("x"))
    return t.where(F.col("x.pos") == "NOUN").select(F.lower("x.word").alias("noun")).distinct()


# ---------------------------------------------------------------- rewriting
@query("join_noun_types")
def q_join_noun_types(spark, d):
    sp = StudyPlan.shared(spark, d)
    w = R.windows(sp.parent, ["uid"]).withColumn("noun", F.lower("word"))
    nt = sp.noun_types.where(F.col("model_type") != 100)
    # one row a noun with its types in every variant: a window meets it once
    by_noun = nt.groupBy("noun").agg(F.collect_list(F.struct("model_type", A.types_str().alias("types"))).alias("t"))
    typed = salted_join(sp.stages.write(w.select("uid", "det_idx", "j", "noun"), "windows"), by_noun, "noun", spread=["uid", "det_idx", "j"])
    return typed.select("uid", "det_idx", "j", "noun", F.explode("t").alias("t")).select(
        "t.model_type", "uid", "det_idx", "j", "noun", "t.types")


@query("sample_replacement")
def q_sample_replacement(spark, d):
    sp = StudyPlan.shared(spark, d)
    nt = sp.noun_types.where(F.col("model_type") != 100)
    dec = R.decisions(sp.parent, nt)
    return R.swap_edits(dec, nt).select("model_type", "uid", "prio", "pos", "new_word")


@query("conflict_count")
def q_conflict_count(spark, d):
    sp = StudyPlan.shared(spark, d)
    nt = sp.noun_types.where(F.col("model_type") != 100)
    return R.conflict_counts(R.decisions(sp.parent, nt))


@query("rewrite_pairs")
def q_rewrite_pairs(spark, d):
    sp = StudyPlan.shared(spark, d)
    out, _ = R.rewrite(sp.parent, sp.noun_types, remove_conflicts=False)
    return out.select("model_type", "uid", "utt")


@query("rewrite_remove")
def q_rewrite_remove(spark, d):
    sp = StudyPlan.shared(spark, d)
    out, _ = R.rewrite(sp.parent, sp.noun_types, remove_conflicts=True)
    return out.select("model_type", "uid", "utt")


@query("rewrite_iterate")
def q_rewrite_iterate(spark, d):
    sp = StudyPlan.shared(spark, d)
    out = R.rewrite_iterate(sp.parent, sp.noun_types, remove_conflicts=False, num_passes=2, cut=sp.stages.write)
    return out.select("model_type", "uid", "utt")


# ---------------------------------------------------------------- bands
from detflow.operators import bands as B  # noqa: E402
from detflow.operators import testsets as TS  # noqa: E402
from detflow.operators.ranking import top_k  # noqa: E402

def study_corpus(spark, d):
    return StudyPlan.shared(spark, d).corpus_variants


def study_bands(spark, d):
    return StudyPlan.shared(spark, d).bands


@query("bin_join")
def q_bin_join(spark, d):
    p = Corpus(spark, d).parent.select("uid", B.band_of(F.col("age_months")).alias("band_hi"))
    return p.where(F.col("band_hi").isNotNull())


@query("bands_range_join")
def q_bands_range_join(spark, d):
    p = Corpus(spark, d).parent
    return p.select(F.explode(B.limits_from(F.col("age_months"))).alias("age"), "uid")


@query("rewrite_all_variants")
def q_rewrite_all(spark, d):
    return study_corpus(spark, d).select("model_type", "uid", "utt")


@query("build_training_bands")
def q_build_training_bands(spark, d):
    return study_bands(spark, d).select("model_type", "band_hi", "uid", "utt")


@query("noun_det_sets")
def q_noun_det_sets(spark, d):
    s = StudyPlan.shared(spark, d).det_sets
    return s.select("model_type", "band_hi", "noun", F.array_join("dets", ",").alias("dets"))


@query("usage_summary")
def q_usage_summary(spark, d):
    return B.usage_summary(StudyPlan.shared(spark, d).det_sets)


@query("first_k_examples")
def q_first_k_examples(spark, d):
    s = StudyPlan.shared(spark, d).det_sets
    has_a, has_the = F.array_contains("dets", "a"), F.array_contains("dets", "the")
    s = s.withColumn("category", F.when(has_a & has_the, "both").when(has_a, "only_a").otherwise("only_the"))
    return top_k(s, ["model_type", "band_hi", "category"], ["noun"], 10, "noun") \
        .select("model_type", "band_hi", "category", "rank", "noun")


@query("training_nouns_by_band")
def q_training_nouns(spark, d):
    return B.training_nouns_by_band(StudyPlan.shared(spark, d).parent)


@query("semi_training_nouns")
def q_semi_training(spark, d):
    sp = StudyPlan.shared(spark, d)
    return TS.target_nouns(sp.noun_types, B.training_nouns_by_band(sp.parent))


@query("set_intersect")
def q_set_intersect(spark, d):
    sp = StudyPlan.shared(spark, d)
    return TS.target_nouns_intersect(sp.noun_types, B.training_nouns_by_band(sp.parent))


def test_sets(spark, d, unique_nouns=True):
    sp = StudyPlan.shared(spark, d)
    return sp.test_sets if unique_nouns else sp.test_sets_all


@query("first_per_noun")
def q_first_per_noun(spark, d):
    return test_sets(spark, d, True).select("model_type", "age", "noun", "uid")


@query("make_test_sets")
def q_make_test_sets(spark, d):
    return test_sets(spark, d, True).select("model_type", "age", "uid", "noun", "utt", "age_months")


@query("deciding_sentences")
def q_deciding(spark, d):
    return test_sets(spark, d, False).select("model_type", "age", "uid", "noun")


# ---------------------------------------------------------------- prediction + evaluation
from detflow.operators import evaluate as E  # noqa: E402
from detflow.operators import predict as PR  # noqa: E402
from detflow.operators import stats as ST  # noqa: E402
from detflow.sources.tables import VARIANTS  # noqa: E402

MODEL_TYPES = [m for m, _ in VARIANTS]


def _r9(c):
    return F.round(F.col(c), 9).alias(c)


def scored_candidates(spark, d):
    return StudyPlan.shared(spark, d).scored


def results(spark, d):
    return StudyPlan.shared(spark, d).results


@query("mask_candidate_det")
def q_mask_candidate(spark, d):
    m = E.masked_candidates(test_sets(spark, d))
    return m.select("model_type", "age", "uid", "actual_det", "masked", "noun")


@query("has_noun_type")
def q_has_noun_type(spark, d):
    g = StudyPlan.shared(spark, d).candidates
    return g.select("model_type", "age", "uid", "noun")


@query("join_gold")
def q_join_gold(spark, d):
    g = StudyPlan.shared(spark, d).candidates
    return g.select("model_type", "age", "uid", "noun", "gold_det")


@query("argmax_prediction")
def q_argmax(spark, d):
    return scored_candidates(spark, d).select("model_type", "age", "uid", "pred_word")


@query("predict_masked")
def q_predict_masked(spark, d):
    return scored_candidates(spark, d).select("model_type", "age", "uid", "pred_det")


@query("eval_counters")
def q_eval_counters(spark, d):
    return StudyPlan.shared(spark, d).counters


@query("eval_ratios")
def q_eval_ratios(spark, d):
    return results(spark, d)


@query("evaluate_variants")
def q_evaluate_variants(spark, d):
    return results(spark, d)


@query("sort_results")
def q_sort_results(spark, d):
    return results(spark, d).orderBy("model_type", "age")


@query("summary_stats")
def q_summary_stats(spark, d):
    s = ST.summary_stats(results(spark, d))
    return s.select("model_type", *[_r9(c) for c in ("misclass_mean", "misclass_std", "det_acc_mean",
                                                     "det_acc_std", "overall_acc_mean", "overall_acc_std")],
                    "total_determiner_preds", "total_preds")


@query("welch_ttest")
def q_welch(spark, d):
    t = ST.welch_ttest(results(spark, d), "total_misclassified", MODEL_TYPES)
    return t.select("model_type_1", "model_type_2", _r9("t_stat"), _r9("p_value"))


@query("pairwise_models")
def q_pairwise(spark, d):
    r = results(spark, d).select("model_type").distinct()
    pairs = spark.range(1).select(ST.pairwise_models(MODEL_TYPES).alias("p")).select("p.*")
    return pairs.join(r.withColumnRenamed("model_type", "model_type_1"), "model_type_1", "left_semi")


@query("coerce_numeric")
def q_coerce_numeric(spark, d):
    return ST.coerce_numeric(results(spark, d).select("model_type", "age", "total_misclassified"),
                             "total_misclassified")


# ---------------------------------------------------------------- children vs model
from detflow.operators import overall as O  # noqa: E402
from detflow.plans.study import OverallPlan  # noqa: E402


@query("overall_eval_set")
def q_overall_eval_set(spark, d):
    return OverallPlan.shared(spark, d).overall.select("uid", "subject", "age_months", "utt")


@query("mask_single_det")
def q_mask_single_det(spark, d):
    return O.mask_single_det(OverallPlan.shared(spark, d).overall).select("uid", "gold_det", "masked", "noun")


@query("flexible_use_counts")
def q_flex_counts(spark, d):
    return O.flexible_use_counts(OverallPlan.shared(spark, d).overall)


@query("set_subset")
def q_set_subset(spark, d):
    nd = O.noun_dets(OverallPlan.shared(spark, d).overall, ["age_months", "subject"])
    return nd.where(F.size(F.array_except(F.array(F.lit("a"), F.lit("the")), F.col("dets"))) == 0) \
        .select("age_months", "subject", "noun")


@query("flexible_use_iqr")
def q_flex_iqr(spark, d):
    return O.flexible_use_iqr(O.flexible_use_counts(OverallPlan.shared(spark, d).overall))


@query("trained_bands")
def q_trained_bands(spark, d):
    return OverallPlan.shared(spark, d).registry.select("model_type", "age", "bytes")


@query("model_availability")
def q_model_availability(spark, d):
    p = OverallPlan.shared(spark, d)
    return O.model_availability(O.mask_single_det(p.overall), registry=p.registry).select("uid", "model_type", "age")


@query("skipped_ages")
def q_skipped_ages(spark, d):
    p = OverallPlan.shared(spark, d)
    return O.skipped_ages(O.mask_single_det(p.overall), p.registry)


@query("key_join_predictions")
def q_key_join_predictions(spark, d):
    return OverallPlan.shared(spark, d).model_preds.select("uid", "age_months", "subject", "pred_det", "noun")


@query("pred_is_det")
def q_pred_is_det(spark, d):
    p = OverallPlan.shared(spark, d).model_preds
    return p.where(F.col("pred_det").isin("a", "the")).select("uid", "pred_det")


@query("replace_det")
def q_replace_det(spark, d):
    p = OverallPlan.shared(spark, d).model_preds.where(F.col("pred_det").isin("a", "the"))
    return p.select("uid", T.words(O.replace_det("tagged", F.col("pred_det"))).alias("utt"))


@query("flexible_use_model")
def q_flex_model(spark, d):
    return O.flexible_use_model(OverallPlan.shared(spark, d).model_preds)


@query("union_ages")
def q_union_ages(spark, d):
    return O.flexible_use_iqr(O.flexible_use_model(OverallPlan.shared(spark, d).model_preds))


def _overall_results(spark, d):
    op = OverallPlan.shared(spark, d)
    child = O.flexible_use_iqr(O.flexible_use_counts(op.overall))
    model = O.flexible_use_iqr(O.flexible_use_model(op.model_preds))
    c = child.select("age_months", *[F.col(x).alias(f"child_{x}") for x in ("median", "q1", "q3")])
    m = model.select("age_months", *[F.col(x).alias(f"model_{x}") for x in ("median", "q1", "q3")])
    return c.join(m, "age_months", "left")


@query("evaluate_overall")
def q_evaluate_overall(spark, d):
    return _overall_results(spark, d)


@query("ordered_age_groups")
def q_ordered_age_groups(spark, d):
    return _overall_results(spark, d).orderBy("age_months")


@query("pred_gold_valid")
def q_pred_gold_valid(spark, d):
    return OverallPlan.shared(spark, d).final_preds.select("uid", "gold_det", "pred_det")


@query("confusion_matrix")
def q_confusion(spark, d):
    cm = O.confusion_matrix(OverallPlan.shared(spark, d).final_preds)
    return cm.select("gold", "pred", "n", _r9("share"))


@query("accuracy_coverage")
def q_accuracy_coverage(spark, d):
    a = O.accuracy_coverage(OverallPlan.shared(spark, d).final_preds)
    return a.select(_r9("accuracy"), _r9("coverage"), "n")


# ---------------------------------------------------------------- vocabulary, loss, charts
from detflow.operators import series as CS  # noqa: E402
from detflow.operators import vocab as V  # noqa: E402


def _tokenizer_texts(spark, d):
    return C.drop_empty(OverallPlan.shared(spark, d).normalized.where(F.col("speaker") == "parent"))


@query("vocab_rank")
def q_vocab_rank(spark, d):
    return V.vocab_rank(V.word_counts(_tokenizer_texts(spark, d))).select("rank", "word", "n")


@query("build_vocab")
def q_build_vocab(spark, d):
    return V.build_vocab(V.word_counts(_tokenizer_texts(spark, d)))


def _encoded(spark, d):
    texts = _tokenizer_texts(spark, d)
    words = V.vocab_words(V.build_vocab(V.word_counts(texts)))
    return V.encode_ids(texts, words), len(words)


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query("encode_ids")
def q_encode_ids(spark, d):
    enc, _ = _encoded(spark, d)
    return enc.select("uid", _ids_str("input_ids").alias("input_ids"), "n_real")


@query("mlm_mask")
def q_mlm_mask(spark, d):
    enc, n = _encoded(spark, d)
    m = V.mlm_mask(enc, n)
    return m.select("uid", _ids_str("masked_ids").alias("masked_ids"), _ids_str("labels").alias("labels"))


@query("cumulative_bands")
def q_cumulative_bands(spark, d):
    return V.cumulative_counts(StudyPlan.shared(spark, d).word_counts)


@query("step_offset")
def q_step_offset(spark, d):
    return StudyPlan.shared(spark, d).step_offsets.select("model_type", "band_hi", "rows", "last_step", "offset")


def _curve(spark, d):
    return StudyPlan.shared(spark, d).loss_curve


@query("train_loss_curve")
def q_train_loss_curve(spark, d):
    return _curve(spark, d).select("model_type", "band_hi", "epoch", "step", "global_step", _r9("loss"))


@query("context_counts")
def q_context_counts(spark, d):
    sp = StudyPlan.shared(spark, d)
    ctx = sp.candidates.select("model_type", "age", "prev", "next")
    return PR.context_counts(sp.triples, ctx)


def _chart(key, chart):
    @query(key)
    def q(spark, d):
        return CS.result_series(results(spark, d), chart)
    return q


for _k, _c in [("series_ratios", "ratios"), ("series_counts", "counts"), ("series_accuracy", "accuracy"),
               ("series_prediction_ratio", "prediction_ratio"), ("series_across_models", "across_models")]:
    _chart(_k, _c)


@query("series_mean_errorbar")
def q_series_mean_errorbar(spark, d):
    s = ST.summary_stats(results(spark, d))
    return CS.mean_errorbar(s).withColumn("value", F.round("value", 9))


@query("series_flexible_use")
def q_series_flexible_use(spark, d):
    return CS.flexible_use_series(_overall_results(spark, d))


@query("series_loss")
def q_series_loss(spark, d):
    return CS.loss_series(_curve(spark, d)).withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- streaming
import uuid as _uuid  # noqa: E402

from detflow.streaming.incremental import incremental_bands  # noqa: E402


@query("incremental_bands")
def q_incremental_bands(spark, d):
    """The bands' text fed band by band to a running stream.  It is made once, and a band is
    read from its folder."""
    text = StudyPlan.shared(spark, d).write_bands(f"stream-{_uuid.uuid4().hex}", ["uid", "utt"], "parquet", "zstd")
    return incremental_bands(spark, spark.read.schema("uid string, utt string, model_type int, band_hi int").parquet(text))


# ---------------------------------------------------------------- sources and sinks (round trips)
from detflow.session import ensure_checkpoint_dir  # noqa: E402
from detflow.sources import io as IO  # noqa: E402


def _out_dir(spark, name):
    """A fresh folder under the shared checkpoint dir (the cluster's shared storage)."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/sinks/{name}-{_uuid.uuid4().hex}"


def _band_files(spark, d):
    return StudyPlan.shared(spark, d).band_files


@query("sink_age_bands")
def q_sink_age_bands(spark, d):
    """K2: one directory per (model_type, band_hi) holding the text only."""
    back = IO.read_band_text(spark, _band_files(spark, d))
    return back.select(F.col("model_type").cast("int").alias("model_type"),
                       F.col("band_hi").cast("int").alias("band_hi"), "utt")


@query("src_band_text")
def q_src_band_text(spark, d):
    """Band files read as text with partition discovery."""
    return q_sink_age_bands(spark, d)


@query("src_loop_variants")
def q_src_loop_variants(spark, d):
    """One read of the partitioned band files, grouped, instead of a loop."""
    back = IO.read_band_text(spark, _band_files(spark, d))
    return back.groupBy(F.col("model_type").cast("int").alias("model_type"),
                        F.col("band_hi").cast("int").alias("band_hi")).agg(F.count(F.lit(1)).alias("n_sentences"))


@query("sink_headerless")
def q_sink_headerless(spark, d):
    """K1 + S3: tagged parent sentences as headerless CSV and back."""
    path = _out_dir(spark, "tagged")
    IO.write_headerless(StudyPlan.shared(spark, d).parent.select("uid", "utt", "age_months", "tagged"), path, "gzip")
    back = IO.decode_tagged(IO.read_headerless(spark, path, ["uid", "utt", "age_months", "tagged"],
                                               ["string", "string", "double", "string"]))
    return back.select("uid", "utt", "age_months", F.size("tagged").alias("n_tok"))


@query("src_headerless")
def q_src_headerless(spark, d):
    return q_sink_headerless(spark, d)


@query("sink_maps")
def q_sink_maps(spark, d):
    """K4 + S5: the five noun-type maps as one table partitioned by model_type."""
    path = _out_dir(spark, "noun_types")
    IO.write_partitioned(StudyPlan.shared(spark, d).noun_types, path, ["model_type"])
    back = spark.read.parquet(path)
    return back.select(F.col("model_type").cast("int").alias("model_type"), "noun", A.types_str().alias("types"))


@query("src_noun_types")
def q_src_noun_types(spark, d):
    return q_sink_maps(spark, d)


@query("sink_test_sets")
def q_sink_test_sets(spark, d):
    """K3 + S6: test sets partitioned by (model_type, age); partitions discovered on read."""
    path = _out_dir(spark, "test_sets")
    ts = StudyPlan.shared(spark, d).test_sets.select("model_type", "age", "uid", "utt", "age_months")
    IO.write_partitioned(ts, path, ["model_type", "age"])
    back = spark.read.parquet(path)
    return back.select(F.col("model_type").cast("int").alias("model_type"), F.col("age").cast("int").alias("age"),
                       "uid", "utt")


@query("discover_partitions")
def q_discover_partitions(spark, d):
    """Test sets written under their file names; age and model type come from the names."""
    path = _out_dir(spark, "test_files")
    IO.write_test_files(StudyPlan.shared(spark, d).test_sets.select("model_type", "age", "uid", "utt"), path)
    return IO.discover_test_files(spark, path, "uid string, utt string").select("model_type", "age", "uid", "utt")


@query("src_decimal_comma")
def q_src_decimal_comma(spark, d):
    """Ages written with ',' as decimal mark and parsed back."""
    path = _out_dir(spark, "decimal_comma")
    ts = StudyPlan.shared(spark, d).test_sets.select(
        "uid", F.regexp_replace(F.format_number("age_months", 1), r"\.", ",").alias("age_months"))
    ts.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.schema("uid string, age_months string").option("header", True).csv(path)
    return IO.parse_decimal_comma(back, ["age_months"]).distinct()


@query("sink_results")
def q_sink_results(spark, d):
    """K5: the 60-row results table as one headed CSV, read back with its schema."""
    path = _out_dir(spark, "results")
    res = results(spark, d)
    IO.write_small_csv(res, path)
    return spark.read.schema(res.schema).option("header", True).csv(path)


@query("sink_overall_set")
def q_sink_overall_set(spark, d):
    """K6: the filtered evaluation set as Parquet."""
    path = _out_dir(spark, "overall")
    OverallPlan.shared(spark, d).overall.select("uid", "subject", "age_months", "utt").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("run_metrics")
def q_run_metrics(spark, d):
    """K7: window and conflict counts of the rewrite decisions, one aggregate, kept in
    the run log and read back from it."""
    sp = StudyPlan.shared(spark, d)
    nt = sp.noun_types.where(F.col("model_type") != 100)
    path = _out_dir(spark, "run_log")
    IO.log_metrics(R.decisions(sp.parent, nt).agg(F.count(F.lit(1)).alias("windows"), F.count_if("conflict").alias("conflicts")),
                   path, sp.stages.run, "rewrite")
    return IO.read_metrics(spark, path, "windows long, conflicts long").select("windows", "conflicts")


@query("preprocess_pipeline")
def q_preprocess_pipeline(spark, d):
    """Stages 1-4 in one go, from the raw corpus (cleaned, normalised, tagged)
    to the noun maps and the training bands, each written once; summary per variant."""
    sp = StudyPlan.shared(spark, d)
    path = _out_dir(spark, "preprocess")
    IO.write_partitioned(sp.noun_types, f"{path}/noun_types", ["model_type"])
    bands = sp.write_bands(f"preprocess-{_uuid.uuid4().hex}", ["uid", "utt"], "parquet", "zstd")
    nt = spark.read.parquet(f"{path}/noun_types").groupBy("model_type").agg(F.count(F.lit(1)).alias("n_nouns"))
    bd = spark.read.parquet(bands).groupBy("model_type").agg(F.count(F.lit(1)).alias("n_sentences"))
    return nt.join(bd, "model_type").select(F.col("model_type").cast("int").alias("model_type"),
                                            "n_nouns", "n_sentences")
