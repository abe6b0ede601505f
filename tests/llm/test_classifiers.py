import zlib

import pytest

from detflow.llm import quality as Q
from detflow.llm import toxicity as T
from detflow.llm.common import read

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label, modulus, held):
    got = {r["doc_id"]: r for r in query(spark, SF).collect()}
    labels = {r["doc_id"]: r[label] for r in read(spark, SF, "labels").collect()}
    assert len(got) == 10000 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) for i, r in got.items())
    test = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    right = sum((s >= 0.5) == (y == 1) for s, y in test) / len(test)
    ones, zeros = [s for s, y in test if y], [s for s, y in test if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    print(label, "accuracy", right, "auc", auc, "recall", sum(s >= .5 for s in ones) / len(ones), "false", sum(s >= .5 for s in zeros))
    return right, auc


def test_toxicity_held_out(spark):
    right, auc = held_out(spark, T.op10_toxicity, "toxic", 5, 0)
    assert right > 0.97 and auc > 0.95     # a few labelled texts hold no toxic word


def test_quality_held_out(spark):
    right, auc = held_out(spark, Q.op9_quality, "quality", 3, 1)
    assert right > 0.95 and auc > 0.95


def brute_best(values):
    return max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0.0)


def test_segments_hold_the_maximum():
    scores = T.Scores({"bad": (3.0, 9.0), "meh": (0.5, 4.0), "^good": (-1.0, -5.0)})
    for text in ["bad x x bad good bad", "good good", "", "meh bad x x x x x x x x x x x x x x bad bad good bad meh", "bad"]:
        tokens = text.encode().split()
        found = T.segments(tokens, scores)
        best = max((s for s, _, _ in found), default=0.0)
        values = [scores[t] - T.DRIFT for t in tokens]
        assert best == pytest.approx(max(0.0, brute_best(values)))
        assert all(sum(values[a:b]) == pytest.approx(s) for s, a, b in found)


@pytest.mark.parametrize("score", [T.score, Q.score])
def test_edges(spark, score):
    rows = [(1, None, 1), (2, "", 1), (3, "!!", 1), (4, "x " * 20000, 1), (4, "x " * 20000, 1), (None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None), (4, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert len(score(spark, df, labels).collect()) == 6
    assert len(score(spark, df, labels.limit(0)).collect()) == 6
    assert score(spark, df.limit(0), labels).count() == 0


def test_word_without_clean_documents_counts(spark):
    plain = " ".join(f"common{k}" for k in range(100))
    rows = [(i, f"common {plain} text {i} " + ("grobian" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(spark, docs, labels)      # eight toxic documents of the fit hold the word and no clean one
    assert model.scores[b"grobian"] > T.MIN_EFFECT and model.scores[b"common"] == 0


def test_toxicity_small_label_set(spark):
    small = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in T.op10_toxicity(spark, small).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, small, "labels").collect()}
    assert all(got[i]["predicted"] == 1 for i in (52, 215, 623, 838, 845, 940))     # 2 to 6 plain toxic words each
    ones = [got[i]["predicted"] for i, y in labels.items() if y and got[i]["held_out"]]
    zeros = [got[i]["predicted"] for i, y in labels.items() if y == 0 and got[i]["held_out"]]
    assert sum(ones) >= 0.8 * len(ones) and sum(zeros) <= 0.05 * len(zeros)
