"""Steps whose cost must grow with the input: what is sorted, shuffled and repeated."""

from pyspark.sql import functions as F

from conftest import tagged_df
from detflow.functions import text as T
from detflow.functions.tagger import tag_rows, tag_tokens
from detflow.operators import assign as A
from detflow.operators import bands as B
from detflow.operators import clean as C
from detflow.operators import editlog as EL
from detflow.operators import pairing as D
from detflow.operators import predict as PR
from detflow.operators import rewrite as R
from detflow.operators import testsets as TS
from detflow.operators import vocab as V
from detflow.sources.stages import Stages

LOG = "model_type int, uid string, edits map<int,string>, dropped boolean"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def base_and_log(spark):
    rows = [(f"d-{i}-0-0", age, text) for i, (age, text) in enumerate(
        [(10.0, "the dog is red"), (14.0, "a dog is here"), (22.0, "the cat is red"), (40.0, "a cat is a cat")])]
    df = spark.createDataFrame(rows, "uid string, age_months double, utt string").withColumn("tagged", tag_tokens(T.tokens("utt")))
    log = spark.createDataFrame([(0, "d-0-0-0", {0: "a"}, False), (25, "d-3-0-0", {}, True)], LOG)
    return B.in_bands(df), log


def test_sentences_without_a_place_take_no_part_in_the_draw(spark):
    names = spark.createDataFrame([(0, "Ann")], "idx bigint, name string")
    df = spark.createDataFrame([("1", "MASK here"), ("1", "nobody"), ("2", None)], "uid string, utt string")
    got = C.replace_mask_names(df, "utt", names, 1, F.col("utt").contains("MASK"))
    assert sorted(map(str, (r["utt"] for r in got.collect()))) == ["Ann here", "None", "nobody"]


def test_noun_flags_are_hash_aggregated(spark):
    df = tagged_df(spark, [("1", [("the", "DET"), ("dog", "NOUN")]), ("2", [("a", "DET"), ("dog", "NOUN")]), ("3", [("a", "DET"), ("cat", "NOUN")])])
    types = A.noun_types_raw(df)
    assert {r["noun"]: r["types"] for r in types.collect()} == {"dog": ["A", "B"], "cat": ["A"]}
    sets = B.noun_det_sets(*base_and_log(spark))
    for df in (types, sets):
        assert "ObjectHashAggregate" not in plan_of(df) and "SortAggregate" not in plan_of(df)
    assert {tuple(r["dets"]) for r in sets.where("model_type = 0 AND noun = 'dog'").collect()} == {("a",)}


def test_the_log_is_hashed_and_sentences_are_not_sorted(spark):
    base, log = base_and_log(spark)
    for df in (EL.signed_triples(base, log), EL.signed_rows(base, log), B.training_corpus(
            base.withColumns({c: F.lit(0) for c in ("k", "id", "turn", "sent_no")}), log)):
        assert "ShuffledHashJoin" in plan_of(df) and "SortMergeJoin" not in plan_of(df)


def test_a_word_of_a_context_is_one_row_on_both_ways(spark):
    tri = EL.signed_triples(*base_and_log(spark))
    ctx = spark.createDataFrame([(0, 58, "is", "[SEP]"), (0, 14, "[CLS]", "dog")], "model_type int, age int, prev string, next string")
    def plain(df):
        return {(r["level"], r["kp"], r["kn"], r["word"]): sorted((-1 if c["model_type"] is None else c["model_type"], tuple(c["n"])) for c in r["counts"])
                for r in df.collect()}
    one, other = PR.context_words(tri, ctx), PR.context_words(tri, ctx, max_rows=0)
    assert one.count() == len(plain(one)) and plain(one) == plain(other)
    here = plain(one)[1, "[CLS]", "dog", "the"]
    assert here == [(-1, (1, *[0] * 11)), (0, (-1, *[0] * 11))]


ASK = [(0, 58, "is", "[SEP]"), (0, 58, "[CLS]", "dog"), (25, 58, "zz", "dog"), (25, 58, "the", "zz"), (0, 58, "zz", "zz")]


def asked(spark, rows=ASK):
    return spark.createDataFrame(rows, "model_type int, age int, prev string, next string")


def test_a_level_counts_only_what_is_asked_of_it(spark):
    base, log = base_and_log(spark)
    tri, names = EL.signed_triples(base, log), []

    def cut(df, name):
        names.append(name)
        return df
    got = {r["prev"]: r["pred_word"] for r in PR.predict(asked(spark, ASK[:2]), tri, cut=cut).collect()}
    assert names == ["contexts", "words_1", "answers_1"] and got == {"is": "red", "[CLS]": "a"}
    early = PR.level_words(tri, asked(spark, [(0, 14, "is", "[SEP]")]), 1).collect()      # the red cat is of band 22
    assert {r["word"]: [x for c in r["counts"] for x in c["n"]] for r in early} == {"red": [1] * 12, "here": [1] * 12}
    for number in (1, 2, 3):
        one, other = (sorted((r["kp"], r["kn"], r["word"], sorted(map(str, r["counts"]))) for r in PR.level_words(
            tri, asked(spark), number, max_rows=n).collect()) for n in (100, 0))
        assert one == other and one


def test_words_of_a_context_are_compared_after_their_counts(spark, monkeypatch):
    tri = EL.signed_triples(*base_and_log(spark))
    one = sorted(map(str, PR.predict(asked(spark), tri).collect()))
    monkeypatch.setattr(PR, "MOST_ROWS", 0)
    assert one == sorted(map(str, PR.predict(asked(spark), tri).collect()))
    best = PR.best_by_level(PR.level_words(tri, asked(spark), 1))
    assert "HashAggregate" in plan_of(best) and "max(" in plan_of(best)


def test_no_token_of_the_base_runs_a_lambda(spark):
    base, _ = base_and_log(spark)
    none = base.limit(1).withColumn("tagged", F.expr("filter(tagged, x -> false)"))
    assert "lambda" not in plan_of(EL.base_triples(base.cache())).split("InMemoryTableScan")[0]
    assert EL.base_triples(none).count() == 0 and EL.base_triples(base).where("prev = '[CLS]'").count() == 4


def test_bucketed_sentences_are_not_sorted_when_written(spark):
    stages, key = Stages(spark, "unsorted"), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    out = stages.write(spark.range(50).selectExpr("cast(id as string) uid", "id % 2 speaker"), "s", ("speaker",), "uid")
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED detflow_s_{stages.run}").collect()}
    assert "uid" in about["Bucket Columns"] and "uid" not in about.get("Sort Columns", "")
    assert out.count() == 50 and spark.conf.get(key, "0") == before


def test_an_earlier_noun_decides_from_its_age_on(spark):
    child = tagged_df(spark, [("u", [("the", "DET"), ("dog", "NOUN"), ("a", "DET"), ("cat", "NOUN")])])
    types = spark.createDataFrame([(0, "dog", ["B"]), (0, "cat", ["A"]), (25, "cat", ["A"]), (25, "dog", ["A", "B"])],
                                  "model_type int, noun string, types array<string>")
    ages = spark.createDataFrame([("dog", 30.0), ("cat", 10.0)], "noun string, min_age double")
    got = TS.make_test_sets(child, types, ages, False, columns=["uid"])
    assert sorted(got.columns) == ["age", "model_type", "noun", "uid"]
    want = {(0, a): "dog" if a >= 30 else "cat" for a in B.BAND_LIMITS} | {(25, a): "cat" for a in B.BAND_LIMITS}
    assert {(r["model_type"], r["age"]): r["noun"] for r in got.collect()} == want and got.count() == 24


def test_a_triple_is_one_row_for_all_variants(spark):
    n = V.triple_counts(EL.signed_triples(*base_and_log(spark)))
    rows = {(r["band_hi"], r["prev"], r["word"], r["next"]): r for r in n.collect()}
    assert len(rows) == n.count()
    r = rows[14, "[CLS]", "the", "dog"]
    assert (r["n_0"], r["n_25"], r["n_100"]) == (0, 1, 1)
    assert rows[42, "[CLS]", "a", "cat"]["n_25"] == 0


def test_words_of_the_base_are_shuffled_once_and_the_variants_are_hashed(spark):
    """A word of a context was shuffled a second time to meet its changes."""
    tri = EL.signed_triples(*base_and_log(spark))
    df = PR.level_words(tri, asked(spark), 2)
    base, own = plan_of(df).split("FullOuter", 1)[1].split("collect_list", 1)
    assert "ObjectHashAggregate" not in base.rsplit("+-", 1)[0] and "model_type" in own
    rows = {(r["kn"], r["word"]): [(c["model_type"], c["n"][-1]) for c in r["counts"]] for r in df.collect()}
    assert rows["dog", "the"] == [(None, 1), (0, -1)] and rows["dog", "a"] == [(None, 1), (0, 1)]


def test_changed_triples_look_at_edited_places_only(spark):
    df = spark.createDataFrame([("u", 10.0, "The Dog sees a cat")], "uid string, age_months double, utt string")
    base = B.in_bands(df.withColumn("tagged", tag_tokens(T.tokens("utt"))))
    log = spark.createDataFrame([(0, "u", {0: "A", 4: "Bird"}, False), (25, "u", {3: "the"}, False)], LOG)
    out = EL.changed_triples(base, log)
    old = {0: [("[CLS]", "the", "dog"), ("the", "dog", "sees"), ("sees", "a", "cat"), ("a", "cat", "[SEP]")],
           25: [("dog", "sees", "a"), ("sees", "a", "cat"), ("a", "cat", "[SEP]")]}
    new = {0: [("[CLS]", "a", "dog"), ("a", "dog", "sees"), ("sees", "a", "bird"), ("a", "bird", "[SEP]")],
           25: [("dog", "sees", "the"), ("sees", "the", "cat"), ("the", "cat", "[SEP]")]}
    want = sorted((m, *t, s) for rows, s in ((old, -1), (new, 1)) for m in rows for t in rows[m])
    assert sorted((r["model_type"], r["prev"], r["word"], r["next"], r["sign"]) for r in out.collect()) == want
    assert plan_of(out).count("transform(tagged") == 0


def test_tags_of_batches_are_those_of_the_rules(spark):
    words = ["the", "The", "AN", "Dog", "dogs", "42", "4a", "٣", "quickly", "Étude", "Éble", "running", "İs", "IS", "ẞly", "K", "Kly", "red", "'er", "we", "Ärger"]
    rows = [(1, words), (2, []), (3, None), (4, words[::-1]), (5, ["Dog"]), (6, ["Dog", "Dog"])]
    df = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1)
    got = tag_rows(df, "t")
    want = df.withColumn("t", tag_tokens("t"))
    assert got.schema["t"].dataType.simpleString() == want.schema["t"].dataType.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_guarded_cleaning_is_the_plain_one(spark):
    texts = ["MASK", " MASK MASK\n", "MASKED", "an An AN ban an", "An", "&1234 &12 & &99999", "joe@x", "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "utt string")
    word = T.WORD_CHAR
    plain = F.regexp_replace(F.regexp_replace("utt", rf"(?<!{word})an(?!{word})", "a"), rf"(?<!{word})An(?!{word})", "A")
    plain = F.regexp_replace(F.translate(plain, "@", ""), r"&[0-9]{4}", "'")
    for r in df.select(plain.alias("want"), T.import_clean("utt").alias("got"), T.is_only_mask("utt").alias("m"),
                       F.regexp_replace("utt", r"^\s+|\s+$", "").isin("MASK", "MASK MASK").alias("n")).collect():
        assert r["want"] == r["got"] and r["m"] == r["n"]


def test_only_sentences_with_a_determiner_are_searched(spark):
    from detflow.plans.study import StudyPlan
    df = tagged_df(spark, [("1", [("the", "DET"), ("dog", "NOUN")]), ("2", [("dog", "NOUN")]), ("3", []), ("4", [("this", "DET"), ("the", "NOUN")])])
    some = StudyPlan.with_det(df)
    assert sorted(r["uid"] for r in some.collect()) == ["1", "4"]
    for step in (A.noun_types_raw, B.first_training_age, TS.child_candidates):
        assert sorted(map(str, step(some).collect())) == sorted(map(str, step(df).collect())) != []


def test_pairs_and_windows_run_no_lambda(spark):
    """every token of a sentence with a determiner ran lambdas, once for each of three steps."""
    rows = [("1", [("The", "DET"), ("big", "ADJ"), ("Dog", "NOUN"), ("a", "DET"), ("a", "NOUN")]), ("2", []), ("3", [("the", "DET")]),
            ("4", [("this", "DET"), ("cat", "NOUN"), ("the", "NOUN"), ("cat", "NOUN")]), ("5", [("a", "DET"), ("b", "X"), ("c", "X"), ("d", "X"), ("e", "NOUN")]),
            ("6", [("the", "DET"), ("a", "DET"), ("x", "ADV"), ("y", "NOUN"), ("z", "NOUN")])]
    df = tagged_df(spark, rows).unionByName(tagged_df(spark, rows[:1]).withColumn("tagged", F.expr("CAST(NULL AS ARRAY<STRUCT<word:STRING,pos:STRING>>)")))
    df = df.cache()
    for ahead, lambdas in ((4, D.pair_assign("tagged")), (2, D.pair_train2("tagged"))):
        want = D.explode_pairs(df, lambdas, ["uid"]).select("uid", "det", "noun")
        assert sorted(map(tuple, D.noun_rows(df, ["uid"], ahead).collect())) == sorted(map(tuple, want.collect())) != []
    for step in (A.noun_types_raw(df), B.first_training_age(df), R.windows(df, ["uid"])):
        assert "lambda" not in plan_of(step)
    assert sorted((r["det_idx"], r["det_type"], r["j"], r["word"]) for r in R.windows(df, ["uid"]).where("uid IN ('3', '6')").collect()) == [
        (0, "B", 1, "a"), (0, "B", 2, "x"), (0, "B", 3, "y"), (1, "A", 2, "x"), (1, "A", 3, "y"), (1, "A", 4, "z")]


def test_decisions_take_the_first_two_typed_words_also_where_a_uid_repeats(spark):
    nt = spark.createDataFrame([(m, n, t) for n, by in (("x", {0: "A"}), ("y", {0: "B", 25: "A"}), ("z", {0: "B", 25: "B"}))
                                for m, t in ((m, [t]) for m, t in by.items())], "model_type int, noun string, types array<string>")
    s = [("the", "DET"), ("x", "X"), ("Y", "X"), ("z", "X")]
    df = tagged_df(spark, [("once", s), ("twice", s), ("twice", s), ("none", [("a", "DET"), ("o", "X")])])
    got = {(r["uid"], r["model_type"]): (r["final_type"], r["conflict"], r["word1"], r["j2"]) for r in R.decisions(df, nt).collect()}
    assert got == {("once", 0): ("A", True, "x", 2), ("once", 25): ("A", True, "y", 3),
                   ("twice", 0): ("A", False, "x", 1), ("twice", 25): ("A", False, "y", 2)}


def test_variants_that_change_a_sentence_alike_are_one_row(spark):
    """the triples of a change were written and looked up once a variant."""
    base, _ = base_and_log(spark)
    log = spark.createDataFrame([*[(m, "d-0-0-0", {0: "a"}, False) for m in (0, 25, 50)], (75, "d-0-0-0", {0: "a", 1: "cat"}, False),
                                 *[(m, "d-3-0-0", {}, True) for m in (0, 75)]], LOG)
    packed = EL.packed_changes(base, log)
    assert packed.count() == 2 * 2 + 2 * 3 + 5 and packed.where("of IS NULL OR of = 0").count() == 0
    assert EL.unpacked(packed).count() == EL.changed_triples(base, log).count() == 3 * 4 + 6 + 2 * 5
    one, other = EL.signed_triples(base, log), EL.packed_triples(base, packed)
    asks = spark.createDataFrame([(m, age, *c) for m in EL.EVERY for age in (14, 58) for c in (
        ("[CLS]", "dog"), ("[CLS]", "cat"), ("a", "[SEP]"), ("none", "is"), ("none", "none"))], "model_type int, age int, prev string, next string")
    assert sorted(map(str, PR.predict(asks, one).collect())) == sorted(map(str, PR.predict(asks, other).collect()))
