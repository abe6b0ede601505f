"""Unit fixtures for cleaning, token and pairing operators (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from conftest import tagged_df
from detflow.functions import text as T
from detflow.operators import filters as P
from detflow.operators import overall as O
from detflow.operators import pairing as D


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr.alias("y")).first()["y"]


def test_only_mask(spark):
    df = spark.createDataFrame([("MASK",), (" MASK MASK ",), ("MASK MASK MASK",)], "utt string")
    assert [r.utt for r in df.where(~T.is_only_mask("utt")).collect()] == ["MASK MASK MASK"]


def test_norm_article_and_entities(spark):
    assert one(spark, T.norm_article(F.col("x")), "an An AN fan") == "a A AN fan"
    assert one(spark, T.norm_article(F.col("x")), "an an an") == "a a a"
    df = spark.createDataFrame([("x&8217s",), ("&12",), ("&82171",)], "x string")
    assert [r.y for r in df.select(T.clean_entities("x").alias("y")).collect()] == ["x's", "&12", "'1"]


def test_expand_repeats(spark):
    assert one(spark, T.expand_repeats(F.col("x")), ["no", "[x3]", "go", "[x0]"], "array<string>") == \
        ["no", "no", "no", "go"]
    assert one(spark, T.expand_repeats(F.col("x")), ["[x2]", "a"], "array<string>") == ["[x2]", "a"]
    assert one(spark, T.expand_repeats(F.col("x")), ["[x2]", "[x3]"], "array<string>") == ["[x2]"] * 3


def test_strip_plus_join(spark):
    assert one(spark, T.strip_plus_join(F.col("x")), ["a+b", "+", "c"], "array<string>") == "ab  c"


def test_filters(spark):
    df = tagged_df(spark, [
        ("keep1", [("the", "DET"), ("dog", "NOUN")]),
        ("keep2", [("a", "DET"), ("big", "ADJ"), ("dog", "NOUN")]),
        ("drop1", [("the", "DET"), ("this", "DET"), ("dog", "NOUN")]),
        ("drop2", [("a", "DET"), ("big", "ADJ"), ("red", "ADJ"), ("dog", "NOUN")]),
    ])
    assert sorted(r.uid for r in df.where(P.det_noun("tagged")).collect()) == ["keep1", "keep2"]
    p14 = tagged_df(spark, [("k", [("this", "DET"), ("x", "DET"), ("dog", "NOUN")])])
    assert p14.where(P.any_det_x_noun("tagged")).count() == 1


def _pairs(df, expr):
    return [(r.det, r.noun) for r in D.explode_pairs(df, expr, ["uid"]).orderBy("det_idx", "noun_idx").collect()]


def test_pairing_presets(spark):
    df = tagged_df(spark, [("s", [("the", "DET"), ("very", "ADV"), ("big", "ADJ"), ("dog", "NOUN")])])
    assert _pairs(df, D.pair_assign("tagged")) == [("the", "dog")]
    assert _pairs(df, D.pair_checking("tagged")) == []
    d3 = tagged_df(spark, [("s", [("the", "DET"), ("Joe", "PROPN")])])
    assert _pairs(d3, D.pair_unbounded("tagged")) == [("the", "joe")]
    d6 = tagged_df(spark, [("s", [("a", "DET"), ("dog", "NOUN"), ("house", "NOUN")])])
    assert _pairs(d6, D.pair_flex("tagged")) == [("a", "dog"), ("a", "house")]
    empty = tagged_df(spark, [("e", [])])
    assert _pairs(empty, D.pair_assign("tagged")) == []


def test_replace_first_det(spark):
    df = tagged_df(spark, [("s", [("the", "DET"), ("a", "DET"), ("dog", "NOUN")])])
    out = df.select(T.words(O.replace_det("tagged", F.lit("a"))).alias("u")).first().u
    assert out == "a a dog"


def test_flexible_use_iqr_nearest_index(spark):
    df = spark.createDataFrame([(20.0, i, v) for i, v in enumerate([5, 1, 3, 2, 9, 7])],
                               "age_months double, subject long, n_flex long")
    r = O.flexible_use_iqr(df).first()
    assert (r.median, r.q1, r.q3) == (4.0, 2, 7)
