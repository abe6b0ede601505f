import re

import corpus_pipeline as C
from detflow.llm import exact_dedup as E
from detflow.llm import line_dedup as D
from detflow.llm import toxicity as T
from detflow.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    scores = {r["doc_id"]: r["score"] for r in T.score(spark, docs, labels).collect()}
    clean = C.without_toxic(spark, docs, SF)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and set(rows) == {i for i, s in scores.items() if s < 0.5}
    best = {}
    for i, t in rows.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
    single = C.without_copies(spark, clean, SF)
    rows = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == docs.columns and set(rows) == {i for _, i in best.values()}
    groups = brute.components(sorted(rows.items()))
    far = C.without_near_copies(spark, single, SF)
    rows = {r["doc_id"]: r["text"] for r in far.collect()}
    assert far.columns == docs.columns and set(rows) == {c for _, c in groups.values()}
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    hits = dict(zip(rows, brute.contamination(rows.values(), items)))
    kept = C.without_benchmark(spark, far, SF)
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and left == {i for i, (_, h, _) in hits.items() if not h}
    out = C.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == left


def test_stages_hold_few_rows_of_text_at_once(spark, monkeypatch):
    usual, seen = spark.conf.get(C.BATCH), []

    def look(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(C.BATCH)))
        return docs
    monkeypatch.setattr(C, "STAGES", [("look", look), ("last", look)])
    assert C.run(spark, SF).count() == read(spark, SF, "documents").count()
    assert seen == [C.BATCH_ROWS, int(usual)] and spark.conf.get(C.BATCH) == usual


def test_fingerprints_compose():
    f = E.Fingerprint(chunk=8)
    data = bytes(range(200)) * 3
    for cut in (0, 1, 7, 8, 100, 600):
        assert f.combine(f.of(data[:cut]), f.of(data[cut:]), len(data) - cut) == f.of(data)


def test_dedup_survives_colliding_fingerprints(spark):
    rows = [(1, "a b", 0), (2, "ab", 0), (3, "ba", 0), (4, "b\ta ", 0), (5, None, 0), (6, " ", 0), (7, "zz", 0), (7, "zz", 0), (None, "ab  ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, version int")
    for primes in (E.PRIMES, (2, 3)):
        got = E.dedup(spark, df, primes=primes).collect()
        assert sorted(((r["doc_id"] or 0), r["keep_id"] or 0, r["group_size"]) for r in got) == [
            (0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 4, 2), (4, 4, 2), (5, 6, 2), (6, 6, 2), (7, 7, 2), (7, 7, 2)]
        assert sum(r["kept"] for r in got) == 4
    assert E.dedup(spark, df.limit(0)).count() == 0


def test_line_dedup_edges(spark):
    line = "A line of more than twenty characters"
    rows = [(1, f"x\n {line}\t\ny", 0), (2, line.lower() + "\n" + line, 0), (3, line, 0), (3, line, 0), (4, None, 0), (5, "", 0),
            (6, "short\nshort", 0), (None, line + "\nz", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines int")
    got = sorted(((r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["text"]) for r in D.drop_lines(spark, df).collect())
    assert got == [(0, 2, 1, "z"), (1, 3, 1, "x\ny"), (2, 2, 2, ""), (3, 1, 0, line), (3, 1, 0, line), (4, 1, 0, ""), (5, 1, 0, ""),
                   (6, 2, 0, "short\nshort")]
    assert D.drop_lines(spark, df.limit(0)).count() == 0


def test_row_filters_keep_clean_texts_of_repeated_and_null_ids(spark):
    import random

    from detflow.llm.decontamination import drop_contaminated
    from detflow.llm.ngram_join import drop_near_copies
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(5))
    rows = [(1, a), (1, b), (1, ""), (2, a + " more"), (2, c), (None, d), (None, e), (None, a), (3, None), (3, d), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    far = {tuple(r) for r in drop_near_copies(spark, df).collect()}
    assert far == set(rows) - {(2, a + " more")}
    items = spark.createDataFrame([(7, " ".join(b.split()[5:20])), (8, " ".join(d.split()[:12]))], "item_id long, text string")
    left = [tuple(r) for r in drop_contaminated(spark, df, items).collect()]
    assert len(left) == len(rows) - 3 and set(left) == {r for r in rows if r[1] not in (b, d)}
