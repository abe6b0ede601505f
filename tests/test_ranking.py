"""The bucketed global rank and the salted two-phase top-k equal brute force."""

from pyspark.sql import functions as F

from detflow.functions.draws import h
from detflow.operators.ranking import dense_index, top_k


def test_dense_index_is_global_order(spark):
    df = spark.createDataFrame([(g, f"w{i}") for g in ("A", "B") for i in range(3000)], "g string, w string")
    out = dense_index(df, ["g"], h("w", F.lit("t")), "w", out="idx", total="n")
    got = out.withColumn("hh", h("w", F.lit("t"))).toPandas()
    for g, part in got.groupby("g"):
        exp = part.sort_values(["hh", "w"]).reset_index(drop=True)
        assert list(exp["idx"]) == list(range(len(exp)))
        assert (part["n"] == len(part)).all()


def test_top_k_matches_sort(spark):
    df = spark.createDataFrame([(i % 3, f"n{i:05d}") for i in range(5000)], "g int, noun string")
    got = top_k(df, ["g"], ["noun"], 10, "noun").toPandas()
    pdf = df.toPandas()
    for g in range(3):
        exp = sorted(pdf[pdf.g == g].noun)[:10]
        assert list(got[got.g == g].sort_values("rank").noun) == exp
