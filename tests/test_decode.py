"""Tag decoding against all paths of short sentences, and joins with hot keys."""

import itertools
import math
import random
from collections import Counter

import pytest
from conftest import tagged_df
from pyspark.sql import functions as F

from detflow.operators import decode as DC
from detflow.operators.joins import hot_keys, join_checked, salted_join

TAGS = ["ADJ", "DET", "NOUN", "VERB"]
WORDS = ["run", "walk", "a", "light", "Blue", "xyz", "the"]


def corpus(seed, n, longest=6):
    rnd = random.Random(seed)
    return [(f"s{i}", [(rnd.choice(WORDS), rnd.choice(TAGS)) for _ in range(rnd.randint(1, longest))]) for i in range(n)]


def brute(train, sentence):
    """The best of all tag paths; ties by the last tag, then the one before, ..."""
    em, tag, tr, before = Counter(), Counter(), Counter(), Counter()
    for _, toks in train:
        prev = "^"
        for w, p in toks:
            em[w.lower(), p] += 1
            tag[p] += 1
            tr[prev, p] += 1
            before[prev] += 1
            prev = p
    micro = lambda x: math.floor(math.log(x) * 1e6 + 0.5)
    known = {w for w, _ in em}
    scores = [micro((tr[a, b] + 1) / (before[a] + len(tag))) for a in [*tag, "^"] for b in tag]
    options = [[(p, micro(em[w.lower(), p] / tag[p])) for p in tag if em[w.lower(), p]] if w.lower() in known else [(own, 0)]
               for w, own in sentence]
    best = None
    for path in itertools.product(*options):
        total, prev = 0, "^"
        for p, e in path:
            total += e + (micro((tr[prev, p] + 1) / (before[prev] + len(tag))) if p in tag and (prev in tag or prev == "^") else min(scores, default=0))
            prev = p
        key = (-total, [p for p, _ in reversed(path)])
        best = min(best, key) if best else key
    return best[1][::-1], -best[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_paths(spark, seed):
    train, test = corpus(seed, 40), corpus(seed + 100, 30)
    test.append(("unseen", [("never", "ADV"), ("a", "NOUN"), ("Met", "X")]))
    got = {r["uid"]: (r["path"], r["score"]) for r in DC.decode(tagged_df(spark, test), tagged_df(spark, train)).collect()}
    assert got == {u: brute(train, toks) for u, toks in test}


def test_context_decides(spark):
    train = [(f"a{i}", [("the", "DET"), ("light", "NOUN")]) for i in range(5)]
    train += [(f"b{i}", [("we", "PRON"), ("light", "VERB")]) for i in range(5)]
    test = [("x", [("the", "DET"), ("Light", "VERB")]), ("y", [("we", "PRON"), ("light", "NOUN")])]
    got = {r["uid"]: r["path"] for r in DC.decode(tagged_df(spark, test), tagged_df(spark, train)).collect()}
    assert got == {"x": ["DET", "NOUN"], "y": ["PRON", "VERB"]}


def test_odd_sentences(spark):
    schema = "uid string, tagged array<struct<word:string,pos:string>>, path string"
    rows = [("none", None, "p"), ("empty", [], "p"), ("nulls", [{"word": None, "pos": None}], "p"),
            ("long", [{"word": "w", "pos": "NOUN"}] * 20000, "p"), (None, [{"word": "w", "pos": "NOUN"}], "p")]
    df = spark.createDataFrame(rows, schema)
    nothing = spark.createDataFrame([], schema)
    got = {r["uid"]: r["path"] for r in DC.decode(df.where("uid IS NOT NULL"), nothing).collect()}
    assert got["none"] == [] and got["empty"] == [] and got["nulls"] == [""] and got["long"] == ["NOUN"] * 20000
    assert DC.decode(nothing, df).count() == 0


def hot_table(spark, n=40000):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 97 == 1, F.lit(None))
                                 .otherwise(F.concat(F.lit("n"), (F.col("id") % 2003).cast("string"))).alias("noun"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    big = hot_table(spark, 5000)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("n3", 3), (None, 4), ("absent", 5)], "noun string, t int")
    got, want = salted_join(big, small, "noun", how), big.join(small, "noun", how)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_no_task_gets_the_hot_noun(spark):
    big = hot_table(spark)
    small = big.where("noun IS NOT NULL").select("noun").distinct().withColumn("t", F.length("noun"))
    hot = hot_keys(big, ["noun"], 8).collect()
    assert len(hot) == 1 and hot[0]["_salts"] == 4
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = {}
        for name, df in (("plain", big.join(small.hint("merge"), "noun")), ("salted", salted_join(big, small, "noun", partitions=64))):
            sizes[name] = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    largest = {k: v[-1] / v[len(v) // 2] for k, v in sizes.items()}
    assert sum(sizes["plain"]) == sum(sizes["salted"])
    assert largest["plain"] > 5 and largest["salted"] <= 3


def test_forced_shuffle_and_unlike_types(spark):
    big = hot_table(spark, 3000)
    small = spark.createDataFrame([("hot", 1)], "noun string, t int")
    assert join_checked(big, small, "noun", max_rows=0).count() == 1500
    assert join_checked(big.limit(0), small, "noun", max_rows=0).count() == 0
    with pytest.raises(ValueError):
        salted_join(big, small.withColumn("noun", F.lit(1)), "noun")
    with pytest.raises(ValueError):
        salted_join(big, small, "noun", "full")
