from detflow.llm import decontamination as D
from detflow.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def compare(got, docs, items):
    texts = [t for _, t in docs]
    want = sorted((i, n, h, ",".join(x)) for (i, _), (n, h, x) in zip(docs, brute.contamination(texts, items)))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == want


def test_op3_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()][:60]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.decontaminate(spark, df, spark.createDataFrame(items, "item_id long, text string")).collect()
    compare(got, docs, items)
    assert any(r["n_hit"] for r in got)


def test_edges(spark):
    w = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(w[:12])), (2, "One two"), (3, None), (4, "..."), (5, "x x x x x x x x x x x"), (6, " ".join(w[1:11])), (7, "solo")]
    docs = [(1, "a. " + "-".join(w[:15]) + " b"), (2, "one, TWO; one two"), (3, None), (4, ""), (5, "x " * 25),
            (6, " ".join(w[:11] + w[:9])), (7, "Solo é solo"), (7, "Solo é solo"), (8, " ".join(w[:5] + ["z"] + w[5:15])), (9, "!!")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, row int")
    it = spark.createDataFrame([(i, t, "p") for i, t in items], "item_id long, text string, phrase string")
    compare(D.decontaminate(spark, df, it).collect(), docs, items)
    assert D.decontaminate(spark, df.limit(0), it).count() == 0
    assert all(r["n_hit"] == 0 for r in D.decontaminate(spark, df, it.limit(0)).collect())
    phrases, _ = D.windows(spark, it, "item_id", "text", 10)
    near = D.Index(spark, df, phrases).near(2).count()
    assert near > 0
