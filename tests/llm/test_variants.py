import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from detflow.llm import variants as V
from detflow.llm.common import read
from tests.llm.brute import ASCII_LOWER


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def around(w, letters):
    yield from (w[:i] + w[i + 1:] for i in range(len(w)))
    yield from (w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters)
    yield from (w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters if c != w[i])


def count(rows, draw=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % draw == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    letters = sorted(set("".join(n)))
    out, form = {}, {}
    for w in n:
        found = {x for x in around(w, letters) if x in n and x != w}
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(found)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("alphabet", ["ab", "aéÿ×"])
def test_search_finds_every_near_word(alphabet):
    rng = random.Random(len(alphabet))
    words = sorted({"".join(rng.choices(alphabet, k=rng.choice([6, 6, 7, 8, 9, 12]))) for _ in range(500)} | {"a" * 6, "a" * 7, "a" * 3000, "a" * 3001})
    both = V.near_in_shard(words, words, True) | V.near_in_shard(words, words, False)
    want = {(a, b) for a in words for b in words if near(a, b)}
    assert both == want and len(want) > 10
    half = lambda a, b: a[:(len(a) - 1) // 2] == b[:(len(a) - 1) // 2]
    for a, b in want:
        if half(a, b):
            assert (a, b) in V.near_in_shard([b], [a], True)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.r_[rng.integers(1, 4, 60), 0]
        assert V.suffix_order(text).tolist() == sorted(range(61), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("shard_words", [4096, 40, 7])
def test_vocabulary_against_brute_force(spark, shard_words):
    rng = random.Random(5)
    n = Counter()
    for _ in range(300):     # many words share their halves, so keys are cut into blocks
        w = rng.choice(["prefix", "pre", "péfix"]) + "".join(rng.choices("abc", k=rng.choice([3, 4]))) + rng.choice(["ending", "ing"])
        n[w] = rng.choice([5, 6, 30, 200, 1500])
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumns({"side": F.lit("x"), "key": F.lit(1), "form": F.lit("f")})
    out = V.group_variants(spark, words.select("word", "n"), shard_words=shard_words)
    assert got(out) == brute(n)
    assert any(r["root"] not in (r["word"], r["form"]) for r in out.collect())


def test_texts(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choices("abcdäE", k=6)) for _ in range(40)]
    rows = [(i if i % 9 else None, " ".join(rng.choices(pool, k=60)) + f"×{i}-_łab") for i in range(60)]
    rows += [(70, None), (71, ""), (72, "Q" * 300_000), (73, ("Q" * 20_000 + " ") * 5), (74, ("Q" * 19_999 + ".") * 30), (1, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"run": F.lit(1), "word": F.lit("w"), "n": F.lit(0), "id": F.lit(3)})
    for draw in (199, 3):
        assert sorted(map(tuple, V.vocabulary(df.repartition(4), draw=draw).select("word", "n").collect())) == sorted(count(rows, draw).items())
    out = got(V.group_variants(spark, V.vocabulary(df, draw=199)))
    n = count(rows)
    long = {w for w in n if len(w) > 1000}
    assert {r[0] for r in out} == set(n) and len(long) == 2
    assert [r for r in out if r[0] not in long] == brute({w: c for w, c in n.items() if w not in long})
    assert {r[4] for r in out if r[0] in long} == {1}
    assert V.group_variants(spark, V.vocabulary(df.limit(0))).count() == 0


def test_op12_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    assert got(V.op12_variants(spark, sf)) == brute(count(rows))
