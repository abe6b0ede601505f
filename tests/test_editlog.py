import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.tagger import tag_tokens
from detflow.operators import bands as B
from detflow.operators import clean as C
from detflow.operators import editlog as EL
from detflow.operators import overall as O
from detflow.operators import pairing as D
from detflow.operators import predict as PR
from detflow.operators import rewrite as R
from detflow.operators import vocab as V

AGES = [10.0, 14.0, 22.0, 40.0]


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences and a log that edits, edits twice and drops."""
    rng = random.Random(4)
    rows, log = [], []
    for i in range(60):
        words = rng.choices(["the", "a", "dog", "cat", "house", "red", "is"], k=rng.randrange(1, 9))
        rows.append((f"d-{i}-0-0", "d", i, 0, 0, AGES[i % 4], " ".join(words)))
        for m in (0, 25, 50, 75):
            kind = rng.randrange(4)
            if kind == 0:
                log.append((m, f"d-{i}-0-0", {rng.randrange(len(words)): "a", len(words) - 1: "bird"}, False))
            elif kind == 1 and rng.random() < 0.5:
                log.append((m, f"d-{i}-0-0", {}, True))
    df = spark.createDataFrame(rows, "uid string, k string, id bigint, turn bigint, sent_no bigint, age_months double, utt string")
    base = B.in_bands(df.withColumn("tagged", tag_tokens(T.tokens("utt")))).cache()
    return base, spark.createDataFrame(log, "model_type int, uid string, edits map<int,string>, dropped boolean").cache()


def plain(corpus):
    """(model_type, band_hi) -> lists of words, with the log applied in Python."""
    base, log = corpus
    edits = {(r["model_type"], r["uid"]): r for r in log.collect()}
    out = defaultdict(list)
    for r in base.collect():
        for m in EL.EVERY:
            words = [x["word"] for x in r["tagged"]]
            e = edits.get((m, r["uid"]))
            if e and e["dropped"]:
                continue
            for pos, w in (e["edits"] if e else {}).items():
                words[pos] = w
            out[m, r["band_hi"]].append(words)
    return out


def test_texts_apply_the_log(corpus):
    got = defaultdict(list)
    for r in B.in_bands(B.training_corpus(*corpus)).collect():
        got[r["model_type"], r["band_hi"]].append(r["utt"].split(" "))
        assert [x["word"] for x in r["tagged"]] == r["utt"].split(" ")
    want = plain(corpus)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_counting_by_difference_equals_counting_the_texts(corpus):
    want = Counter()
    for (m, b), sentences in plain(corpus).items():
        for words in sentences:
            p = [EL.CLS, *words, EL.SEP]
            want.update((m, b, *p[i:i + 3]) for i in range(len(words)))
    n = EL.count_by(EL.signed_triples(*corpus), ["band_hi", "prev", "word", "next"])
    assert {tuple(r)[:-1]: r["n"] for r in n.collect()} == dict(want)
    pairs = lambda t: D.pair_checking(t, 4)
    direct = B.in_bands(B.training_corpus(*corpus)).select("model_type", "band_hi", F.explode(pairs("tagged")).alias("p"))
    direct = direct.groupBy("model_type", "band_hi", "p.noun", "p.det").count()
    n = EL.count_by(EL.signed_pairs(*corpus, pairs), ["band_hi", "noun", "det"])
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, direct.collect()))
    rows = EL.count_by(EL.signed_rows(*corpus), ["band_hi"])
    assert {(r["model_type"], r["band_hi"]): r["n"] for r in rows.collect()} == {k: len(v) for k, v in plain(corpus).items() if v}


def test_predictions_equal_a_plain_search(spark, corpus):
    ask = [(m, age, p, n) for m in (0, 50, 100) for age in (14, 42) for p, n in (("[CLS]", "dog"), ("is", "cat"), ("zz", "house"), ("zz", "zz"), ("the", "zz"))]
    got = PR.predict(spark.createDataFrame(ask, "model_type int, age int, prev string, next string"), EL.signed_triples(*corpus))
    tri = [(m, b, *([EL.CLS, *w, EL.SEP][i:i + 3])) for (m, b), s in plain(corpus).items() for w in s for i in range(len(w))]
    for r in got.collect():
        levels = [lambda p, n: p == r["prev"] and n == r["next"], lambda p, n: n == r["next"], lambda p, n: p == r["prev"], lambda p, n: True]
        for fits in levels:
            c = Counter(w for m, b, p, w, n in tri if m == r["model_type"] and b <= r["age"] and fits(p, n))
            if c:
                break
        assert r["pred_word"] == min(c, key=lambda w: (-c[w], w))


def test_remove_mode_needs_two_hash_exchanges(spark, corpus):
    """One to bring a sentence's windows together, one for the sentences."""
    base, _ = corpus
    nt = spark.createDataFrame([(0, "dog", ["A"]), (0, "cat", ["B"]), (0, "house", ["A", "B"])], "model_type int, noun string, types array<string>")
    codes = nt.checkpoint()
    out, _ = R.rewrite(base, codes, True, variants=[(0, 0.0)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(uid") <= 2


def test_two_passes_merge(spark):
    first = spark.createDataFrame([(0, "u", {1: "a", 2: "b"}, False, 1), (0, "v", {0: "x"}, False, 1)], "model_type int, uid string, edits map<int,string>, dropped boolean, pass_no int")
    then = spark.createDataFrame([(0, "u", {2: "c", 5: "d"}, False, 2)], "model_type int, uid string, edits map<int,string>, dropped boolean, pass_no int")
    got = {r["uid"]: r["edits"] for r in R.merged_logs(first, then).collect()}
    assert got == {"u": {1: "a", 2: "c", 5: "d"}, "v": {0: "x"}}


def test_em_losses_fall_and_equal_a_plain_loop(corpus):
    counts = EL.count_by(EL.signed_triples(*corpus), ["band_hi", "prev", "next", "word"]).cache()
    got = {(r["model_type"], r["band_hi"], r["epoch"]): r["loss"] for r in V.em_losses(V.level_probabilities(counts)).collect()}
    rows = [tuple(r[c] for c in ("model_type", "band_hi", "prev", "next", "word", "n")) for r in counts.collect()]
    for m, band in {(r[0], r[1]) for r in rows}:
        seen = [r for r in rows if r[0] == m and r[1] <= band]
        share = lambda fits, w: sum(r[5] for r in seen if fits(r) and r[4] == w) / sum(r[5] for r in seen if fits(r))
        here = []
        for _, b, p, n, w, k in seen:
            if b == band:
                fits = [lambda r: r[2] == p and r[3] == n, lambda r: r[3] == n, lambda r: r[2] == p, lambda r: True]
                here.append((k, [share(f, w) for f in fits]))
        weights, total, losses = [0.25] * 4, sum(k for k, _ in here), []
        for _ in range(3):
            mixes = [sum(x * y for x, y in zip(weights, ps)) for _, ps in here]
            losses.append(sum(-k * math.log(x) for (k, _), x in zip(here, mixes)) / total)
            weights = [sum(k * weights[i] * ps[i] / x for (k, ps), x in zip(here, mixes)) / total for i in range(4)]
        assert [got[m, band, e] for e in (1, 2, 3)] == pytest.approx(losses, abs=1e-12)
        assert losses[0] >= losses[1] >= losses[2]


def test_quartiles_equal_sorting(spark):
    rng = random.Random(6)
    rows = [(float(age), f"s{i}", rng.choice([0, 0, 1, 5, 9, rng.randrange(100)])) for age in range(12) for i in range(1 + age * 3)]
    out = O.flexible_use_iqr(spark.createDataFrame(rows, "age_months double, subject string, n_flex bigint"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        x = sorted(v for a, _, v in rows if a == r["age_months"])
        n = len(x)
        assert (r["q1"], r["q3"], r["median"]) == (x[n // 4], x[3 * n // 4], (x[(n - 1) // 2] + x[n // 2]) / 2)


def test_names_and_nulls(spark):
    names = spark.createDataFrame([(0, "Ann")], "idx bigint, name string")
    rows = [("1", "MASK, said (MASK)"), ("2", None), ("3", "MASKS aMASK MASK_"), ("4", "x@y and @"), ("5", "")]
    df = spark.createDataFrame(rows, "uid string, utt string")
    assert dict(map(tuple, C.replace_mask_names(df, "utt", names, 1).collect())) == {
        "1": "Ann, said (Ann)", "2": None, "3": "MASKS aMASK MASK_", "4": "x@y and @", "5": ""}
    assert dict(map(tuple, C.replace_at_names(df, "utt", names, 1).collect()))["4"] == "Ann and Ann"


def test_large_repeat_markers_are_words(spark):
    df = spark.createDataFrame([(["hi", "[x2000000000]", "[x99999999999]", "[x002]"],)], "t array<string>")
    assert df.select(T.expand_repeats("t")).first()[0] == ["hi", "[x2000000000]", "[x99999999999]", "[x99999999999]"]
    df = spark.createDataFrame([(["hi", "[x999]"],), (None,), ([],)], "t array<string>")
    assert [len(r[0]) if r[0] is not None else None for r in df.select(T.expand_repeats("t")).collect()] == [999, None, 0]
