import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from detflow.llm import phrases as P
from detflow.llm.common import read
from tests.llm.brute import sha


def brute(rows, window=35):
    """(doc_id, n_words, n_removed, digest) a row."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=repr)


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(300)]
    passage, base = rng.choices(vocabulary, k=60), rng.choices(vocabulary, k=200)
    rows = []
    for i in range(140):
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 34, 35, 36, 80, 150]))
        if i % 4 == 0:      # a passage, whole or cut, in other words
            a, b = rng.choice([(0, 60), (0, 35), (3, 38), (10, 44), (20, 60), (26, 60)])
            words[len(words) // 2:len(words) // 2] = passage[a:b]
        elif i % 4 == 1:    # near copies
            words = list(base)
            words[rng.randrange(200)] = "changed"
            words = words[rng.randrange(40):]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200, None), (201, ""), (202, "x " * 3000), (203, "a b " * 40), (204, "a b\x0b" * 30), (205, rows[5][1]), (205, rows[5][1]), (None, rows[7][1]),
             (206, "y " * 34), (207, "   z" * 60)]
    return rows


def test_anchors_follow_the_window():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    seq = P.Sequences(words)
    anchor, first, count = P.anchors(seq, 35, 8)
    assert count.sum() == 400 - 34 and first.tolist() == [0, *np.cumsum(count)[:-1]]
    of = {i: a for a, f, c in zip(anchor.tolist(), first, count) for i in range(f, f + c)}
    again = P.Sequences(words[100:200])
    anchor, first, count = P.anchors(again, 35, 8)
    for a, f, c in zip(anchor.tolist(), first, count):
        assert all(of[100 + i] == a for i in range(f, f + c))
    assert again.hash(1, np.array([3]), 40) == seq.hash(1, np.array([103]), 40)


def test_automaton_keeps_to_words():
    a = P.Automaton()
    for phrase in (b"one two three", b"two three four", b"ab c"):
        a.add(phrase)
    assert a.spans(b"zero one two three four five") == [(1, 5)]
    assert a.spans(b"a b c ab c one two") == [(3, 5)]
    assert P.Automaton().spans(b"a b") == []


@pytest.mark.parametrize("shard_segments", [4096, 3])
def test_against_brute_force(spark, shard_segments):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "anchor", "at", "weight", "kind", "words")})
    assert got(P.drop_phrases(spark, df.repartition(6), digest=True, shard_segments=shard_segments)) == brute(rows)


def test_long_text_and_kept_words(spark):
    rng = random.Random(9)
    long = " ".join(rng.choices([f"v{i}" for i in range(5000)], k=150_000))
    words = long.split()
    rows = [(1, long), (2, "start " + " ".join(words[70_000:70_100]) + " end")]
    out = {r["doc_id"]: r for r in P.drop_phrases(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["n_removed"] == 100 and out[1]["text"] == " ".join(words[:70_000] + words[70_100:])
    assert out[2]["text"] == "start end"


def test_empty_table(spark):
    out = P.drop_phrases(spark, spark.createDataFrame([], "doc_id long, text string"), digest=True)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 0


def test_op11_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    assert got(P.op11_phrases(spark, sf)) == brute(rows)


def test_a_word_of_an_automaton_has_two_letters():
    codes = P.Codes()
    made = [codes.add(b"%d" % i) for i in range(70_000)]
    assert len(set(made)) == 70_000 and {len(c) for c in made} == {2} and codes[b"none"] == P.Codes.NONE
    first, second = ({c[k] for c in made} for k in (0, 1))
    assert not first & second and not set(P.Codes.NONE) & (first | second) and len(first) == P.Codes.BASE


def test_kept_words_of_overlapping_and_touching_spans():
    spans = [[{"first": 7, "behind": 9}, {"first": 1, "behind": 4}, {"first": 3, "behind": 5}, {"first": 5, "behind": 6}], None, [], [{"first": 0, "behind": 12}]]
    text = " ".join(f"é{i}" for i in range(12))
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(range(4)), P.pa.array([text, text, None, text]), P.pa.array(spans)], ["doc_id", "text", "spans"])
    out = next(P.kept_rows([batch], False)).to_pylist()
    assert [(r["n_words"], r["n_removed"], r["text"]) for r in out] == [(12, 7, "é0 é6 é9 é10 é11"), (12, 0, text), (0, 0, ""), (12, 12, "")]
