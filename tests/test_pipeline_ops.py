"""Assignment, rewriting, test selection, ratios and steps on hand-made inputs."""

from pyspark.sql import functions as F

from conftest import tagged_df
from detflow.operators import assign as A
from detflow.operators import evaluate as E
from detflow.operators import rewrite as R
from detflow.operators import testsets as TS
from detflow.operators import vocab as V


def types_df(spark, rows, model_type=0):
    return spark.createDataFrame([(model_type, n, t) for n, t in rows], "model_type int, noun string, types array<string>")


def rewrite_one(spark, words, types, remove=False):
    df = tagged_df(spark, [("s", words)])
    out, _ = R.rewrite(df, types_df(spark, types), remove, variants=[(0, 0.0)])
    rows = out.collect()
    return rows[0].utt if rows else None


def test_rewrite_rules(spark):
    dog_a = [("dog", ["A"])]
    assert rewrite_one(spark, [("The", "DET"), ("dog", "NOUN")], dog_a) == "a dog"
    assert rewrite_one(spark, [("The", "DET"), ("dog", "NOUN")], [("dog", ["B"])]) == "The dog"
    assert rewrite_one(spark, [("a", "DET"), ("dog", "NOUN"), ("cat", "NOUN")],
                       [("dog", ["A", "B"]), ("cat", ["B"])]) == "the dog cat"
    conflict = [("the", "DET"), ("dog", "NOUN"), ("cat", "NOUN")]
    assert rewrite_one(spark, conflict, [("dog", ["A"]), ("cat", ["B"]), ("hat", ["A"])]) == "a dog hat"
    assert rewrite_one(spark, conflict, [("dog", ["A"]), ("cat", ["B"])]) == "a dog cat"
    assert rewrite_one(spark, conflict, [("dog", ["A"]), ("cat", ["B"]), ("hat", ["A"])], remove=True) is None


def test_keep_both_share_exact(spark):
    raw = spark.createDataFrame([(f"n{i}", ["A", "B"]) for i in range(7)] + [("x", ["A"])],
                                "noun string, types array<string>")
    nt = A.assign_types(raw, [(25, 0.25), (100, 1.0)])
    both = {r.model_type: r.c for r in nt.where(F.size("types") == 2).groupBy("model_type")
            .agg(F.count(F.lit(1)).alias("c")).collect()}
    assert both[25] == 1 and both[100] == 7
    assert nt.where((F.col("model_type") == 100) & (F.col("noun") == "x")).first().types == ["A"]


def test_swap_never_returns_word1(spark):
    nouns = [(f"w{i}", ["A"]) for i in range(30)] + [("cat", ["B"])]
    rows = [(f"s{i}", [("the", "DET"), (f"w{i}", "NOUN"), ("cat", "NOUN")]) for i in range(30)]
    df = tagged_df(spark, rows)
    nt = types_df(spark, nouns)
    dec = R.decisions(df, nt)
    sw = R.swap_edits(dec, nt).join(dec.select("uid", "word1"), "uid")
    assert sw.count() == 30
    assert sw.where(F.col("new_word") == F.col("word1")).count() == 0


def test_unique_nouns_first_sentence(spark):
    child = tagged_df(spark, [("u1", [("the", "DET"), ("dog", "NOUN")]), ("u2", [("a", "DET"), ("dog", "NOUN")])])
    nt = types_df(spark, [("dog", ["B"])])
    first_age = spark.createDataFrame([("dog", 10.0)], "noun string, min_age double")
    uniq = TS.make_test_sets(child, nt, first_age, True).where(F.col("age") == 14).collect()
    every = TS.make_test_sets(child, nt, first_age, False).where(F.col("age") == 14).collect()
    assert [r.uid for r in uniq] == ["u1"] and sorted(r.uid for r in every) == ["u1", "u2"]


def test_zero_denominators(spark):
    c = spark.createDataFrame([(0, 14, 0, 0, 5, 0, 0, 0, 0)],
                              "model_type int, age int, a_predictions long, the_predictions long, "
                              "total_predictions long, a_to_the long, the_to_a long, pred_a_or_the long, correct long")
    r = E.ratios(c).first()
    assert r.total_misclassified == 0.0 and r.determiner_accuracy == 0.0 and r.overall_accuracy == 0.0


def test_step_offsets(spark):
    bands = spark.createDataFrame([(0, b, f"u{b}-{i}") for b in (14, 18, 22) for i in range(3)],
                                  "model_type int, band_hi int, uid string")
    rows = sorted((r.band_hi, r.last_step, r.offset) for r in V.step_offsets(bands).collect())
    assert rows == [(14, 3, 0), (18, 3, 4), (22, 3, 8)]
