import random

import numpy as np
import pyarrow as pa

from detflow.llm import ngram_join as J
from detflow.llm.common import read
from tests.llm import brute


def check(got, rows):
    want = brute.components(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, *want[i]) for i, _ in rows)


def test_fixture_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    common = rng.choices(vocabulary, k=30)
    rows, base = [], rng.choices(vocabulary, k=120)
    for i in range(260):
        if i % 3 == 0:          # one large group of near copies, at and around the threshold
            words = list(base)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif i % 3 == 1:        # a passage that many share
            words = common + rng.choices(vocabulary, k=rng.choice([2, 5, 10, 60]))
        else:
            words = rng.choices(vocabulary[:6], k=rng.randrange(9))
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b\x0bC"), (1004, "a  B c"), (1005, rows[0][1]), (1006, "x " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, size int, class string")
    got = J.join(spark, df.repartition(5)).collect()
    check(got, rows)
    assert len({r["component_id"] for r in got}) < len(rows) - 20
    # the exhaustive step alone gives the same components
    check(J.join(spark, df, rounds=0).collect(), rows)


def test_rows_and_nulls(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "x"), (2, "A B C D E", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in J.join(spark, df).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert J.join(spark, df.limit(0)).count() == 0


def test_tree_walk_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        probe = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
        sets = []
        for _ in range(12):
            s = probe[rng.random(len(probe)) > rng.choice([0.02, 0.08, 0.2])]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 400, rng.integers(1, 20)).astype(np.uint64)])))
        sets.sort(key=lambda s: s.astype(">u8").tobytes())
        walk = J.TreeWalk(probe, 85)
        for s in sets:
            both = len(np.intersect1d(s, probe))
            assert walk.links(s) == (100 * both >= 85 * (len(s) + len(probe) - both))


def test_op7_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    check(J.op7_ngram_join(spark, sf).collect(), rows)


def test_forest_of_a_pair_of_blocks():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 10_000, 200).astype(np.uint64))
    sets = [np.delete(base, rng.choice(len(base), 3, replace=False)) for _ in range(30)]
    sets += [np.unique(rng.integers(20_000, 30_000, 50).astype(np.uint64)) for _ in range(5)]
    rows = [(1, 2, side, i, i // 2 if i < 10 else i, s.astype(">u8").tobytes()) for side in (0, 1) for i, s in enumerate(sets)]
    rows.sort(key=lambda r: (r[2], r[5]))
    kinds = [pa.int64()] * 5 + [pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                       ["low", "high", "side", "class", "component", "set"])
    edges = [e for out in J.verify_units([batch.slice(0, 50), batch.slice(50)], 85) for e in zip(*(c.to_pylist() for c in out.columns))]
    nodes = {r[4] for r in rows if r[3] < 30}
    assert len(edges) == len(nodes) - 1             # a tree, not all pairs
    forest = J.Forest()
    for a, b in edges:
        forest.parent[forest.root(a)] = forest.root(b)
    assert len({forest.root(n) for n in nodes}) == 1


def test_least_number_shared_by_heads():
    rng = np.random.default_rng(8)
    smaller, larger = J.shared_least(85)
    for _ in range(4000):
        n = int(rng.integers(6, 120))
        x = np.unique(rng.integers(0, 10**6, n))
        y = np.union1d(x[rng.random(len(x)) > rng.choice([0, 0.03, 0.08])], rng.integers(0, 10**6, int(rng.integers(0, 1 + n // 6))))
        x, y = sorted((x, y), key=len)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            o = len(np.intersect1d(x[:2 * J.spare(len(x), 85)], y[:2 * J.spare(len(y), 85)]))
            assert o >= smaller * len(x) and o >= larger * len(y)
            t = 0.85
            assert o >= min(a * (0.3 - 1 + t / (1 + t)) + b * t / (1 + t) for a, b in ((len(x), len(y)), (len(y), len(x)))) - 1e-6
