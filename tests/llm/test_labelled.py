from detflow.llm.labelled import training_texts


def test_bound_holds_for_repeated_rows(spark):
    rows = [(7, "one text")] * 300 + [(7, "another text")] * 40 + [(i, f"text {i}") for i in range(20, 60)] + [(None, "no id"), (9, None), (9, "nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in (7, 9, *range(20, 60))], "doc_id long, toxic int")
    got = [tuple(r) for r in training_texts(spark, docs, labels, "toxic", 5, 0, 1000).collect()]
    texts = [t for t, _ in got]
    assert len(got) <= 42 and len(set(texts)) == len(texts) and None not in texts
    assert sum(t in ("one text", "another text") for t in texts) == 1
    again = [tuple(r) for r in training_texts(spark, docs.repartition(2), labels, "toxic", 5, 0, 1000).collect()]
    assert sorted(again) == sorted(got)
    assert len(training_texts(spark, docs, labels, "toxic", 5, 0, 10).collect()) <= 10
