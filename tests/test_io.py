"""Sources and sinks round trips."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from conftest import tagged_df
from detflow.sources import io as IO


def test_corpus_csv_and_headerless(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "corpus.csv")
    with open(p, "w") as f:
        f.write(',subject,age_months,p_utts,c_utts\n0,s1,14.0,"the dog, ""big""",\n1,s2,18.0,,a cat\n')
    df = IO.read_corpus_csv(spark, p)
    assert df.columns == ["subject", "age_months", "p_utts", "c_utts"]
    assert df.where(F.col("subject") == "s1").first().p_utts == 'the dog, "big"'
    out = os.path.join(tmpdir_path, "headerless")
    IO.write_headerless(df.select("p_utts", "age_months"), out)
    back = IO.read_headerless(spark, out, ["utt", "age_months"], ["string", "double"])
    assert back.count() == 2


def test_corpus_csv_round_trip_and_splits(spark, tmpdir_path):
    rows = [("u1", 1, 14.0, ' two  blanks, "quoted" ', None), ("u2", 2, None, None, "tab\t, comma"), ("u3", 3, 18.0, "\\", "é")]
    df = spark.createDataFrame(rows, "uid string, subject bigint, age_months double, p_utts string, c_utts string")
    p = os.path.join(tmpdir_path, "corpus")
    IO.write_corpus_csv(df, p, F.xxhash64("uid"))
    schema = Ty.StructType([Ty.StructField("_index", Ty.LongType()), *df.schema.fields])
    assert sorted(map(tuple, IO.read_corpus_csv(spark, p, schema).collect())) == sorted(rows)
    one = os.path.join(tmpdir_path, "one")
    IO.write_headerless(spark.range(50000).select(F.concat(F.lit("a b "), "id").alias("utt")).coalesce(1), one)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = IO.read_headerless(spark, one, ["utt"])
        assert back.rdd.getNumPartitions() > 1 and back.count() == 50000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_breaks_in_fields_need_multi_line(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "breaks.csv")
    with open(p, "w") as f:
        f.write('"two\nlines",14.0\n')
    assert IO.read_headerless(spark, p, ["utt", "age"], multi_line=True).first().utt == "two\nlines"


def test_test_files_by_name(spark, tmpdir_path):
    rows = [(0, 14, "u1", 'the "dog", it'), (0, 14, "u2", " a cat"), (100, 58, "u3", "x")]
    df = spark.createDataFrame(rows, "model_type int, age int, uid string, utt string")
    p = os.path.join(tmpdir_path, "files")
    IO.write_test_files(df, p)
    assert os.path.isdir(os.path.join(p, "file=test_14_months_0.txt"))
    back = IO.discover_test_files(spark, p, "uid string, utt string").select("model_type", "age", "uid", "utt")
    assert sorted(map(tuple, back.collect())) == rows


def test_names_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "names")
    IO.write_names(spark.createDataFrame([("Zoë",), ("O'Neil, Ann",)], "name string"), p)
    assert sorted(r.name for r in IO.read_names(spark, p).collect()) == ["O'Neil, Ann", "Zoë"]


def test_tagged_json_round_trip(spark):
    df = tagged_df(spark, [("s", [("the", "DET"), ("dog", "NOUN")])])
    enc = IO.encode_tagged(df.select("uid", "tagged"))
    bad = enc.union(spark.createDataFrame([("b", "not json")], "uid string, tagged string"))
    dec = {r.uid: r.tagged for r in IO.decode_tagged(bad).collect()}
    assert [x.word for x in dec["s"]] == ["the", "dog"] and dec["b"] == []


def test_discover_and_decimal_comma(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "tests")
    os.makedirs(d)
    for age, mt in [(14, 0), (58, 100)]:
        with open(os.path.join(d, f"test_{age}_months_{mt}.txt"), "w") as f:
            f.write("utt,age_months\nthe dog,\"14,5\"\n")
    with open(os.path.join(d, "other.txt"), "w") as f:
        f.write("utt,age_months\nx,1\n")
    df = IO.discover_test_files(spark, d)
    assert sorted((r.age, r.model_type) for r in df.collect()) == [(14, 0), (58, 100)]
    assert IO.parse_decimal_comma(df, ["age_months"]).first().age_months == 14.5


def test_band_sink_and_text_source(spark, tmpdir_path):
    bands = spark.createDataFrame([(0, 14, "the dog"), (0, 18, "a cat"), (100, 14, "the cat")],
                                  "model_type int, band_hi int, utt string")
    out = os.path.join(tmpdir_path, "bands")
    IO.write_age_bands(bands, out)
    back = IO.read_band_text(spark, out)
    assert back.where((F.col("model_type") == 0) & (F.col("band_hi") == 18)).first().utt == "a cat"


def test_run_metrics_observation(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "conflict boolean")
    obs_df, obs = IO.run_metrics(df, "m", "conflict")
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "conflicts": 2}
