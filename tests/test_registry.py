"""The registry of trained bands, and ages that it makes the study skip."""

import pytest
from pyspark.sql import functions as F

from detflow.operators import overall as O
from detflow.sources import io as IO


def write(spark, path, bands):
    rows = [(m, b, f"text {b} é") for m, b in bands]
    IO.write_age_bands(spark.createDataFrame(rows, "model_type int, band_hi int, utt string"), path)


@pytest.fixture()
def sentences(spark):
    return spark.createDataFrame([("u1", 14.0), ("u2", 18.4), ("u3", 18.9), ("u4", 22.0), ("u5", None), ("u6", 10.0)],
                                 "uid string, age_months double")


def answers(spark, path, sentences):
    reg = IO.discover_bands(spark, path)
    kept = {r["uid"] for r in O.model_availability(sentences, 100, reg).collect()}
    skipped = {(r["age"], r["n_sentences"]) for r in O.skipped_ages(sentences, reg, 100).collect()}
    return kept, skipped


def test_a_missing_band_changes_the_answer(spark, tmpdir_path, sentences):
    write(spark, f"{tmpdir_path}/all", [(100, 14), (100, 18), (100, 22), (50, 10)])
    assert answers(spark, f"{tmpdir_path}/all", sentences) == ({"u1", "u2", "u3", "u4"}, {(None, 1), (10, 1)})
    write(spark, f"{tmpdir_path}/less", [(100, 14), (100, 22), (50, 10)])
    assert answers(spark, f"{tmpdir_path}/less", sentences) == ({"u1", "u4"}, {(None, 1), (10, 1), (18, 2)})


def test_registry_rows(spark, tmpdir_path):
    write(spark, tmpdir_path, [(100, 14), (100, 14), (0, 58)])
    spark.range(1).select(F.lit("x").alias("value")).write.text(f"{tmpdir_path}/other/notes")
    got = {(r["model_type"], r["age"], r["bytes"]) for r in IO.discover_bands(spark, tmpdir_path).collect()}
    assert got == {(100, 14, 22), (0, 58, 11)}        # é is two bytes, and a line end for each row


def test_registry_reads_no_content(spark, tmpdir_path):
    write(spark, tmpdir_path, [(100, 14)])
    plan = IO.discover_bands(spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_no_bands(spark, tmpdir_path, sentences):
    write(spark, tmpdir_path, [])
    kept, skipped = answers(spark, tmpdir_path, sentences)
    assert kept == set() and sum(n for _, n in skipped) == 6
    assert O.model_availability(sentences, 100).count() == 4
