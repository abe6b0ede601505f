import glob

from pyspark.sql import functions as F

from detflow.sources import io as IO


def files(path, pattern="part-*"):
    return sorted(glob.glob(f"{path}/*/*/{pattern}"))


def rows(spark, n=4000):
    return spark.range(0, n, 1, 16).select((F.col("id") % 5 * 25).cast("int").alias("model_type"), (F.col("id") % 3).cast("int").alias("band_hi"),
                                           F.concat(F.lit("u"), "id").alias("utt"))


def test_one_file_a_small_partition_and_none_more_on_a_second_run(spark, tmpdir_path):
    out = tmpdir_path + "/bands"
    for _ in range(2):
        IO.write_age_bands(rows(spark), out)
        assert len(files(out)) == 15            # 16 map tasks, 15 partitions
        back = IO.read_band_text(spark, out)
        assert back.count() == 4000 and back.distinct().count() == 4000


def test_other_partitions_stay(spark, tmpdir_path):
    out = tmpdir_path + "/parts"
    IO.write_partitioned(rows(spark), out, ["model_type", "band_hi"])
    new = rows(spark).where("model_type = 25 AND band_hi = 1").limit(7)
    IO.write_partitioned(new, out, ["model_type", "band_hi"])
    n = {(r[0], r[1]): r[2] for r in spark.read.parquet(out).groupBy("model_type", "band_hi").count().collect()}
    assert n[25, 1] == 7 and len(n) == 15 and sum(n.values()) == 4000 - 267 + 7


def test_a_large_partition_gets_several_writers(spark, tmpdir_path):
    out = tmpdir_path + "/large"
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        one = spark.range(0, 60_000, 1, 16).select(F.lit(0).alias("model_type"), F.lit(14).alias("band_hi"), F.sha2(F.col("id").cast("string"), 256).alias("utt"))
        IO.write_partitioned(one, out, ["model_type", "band_hi"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(files(out)) > 4 and spark.read.parquet(out).count() == 60_000


def test_run_log_has_a_row_a_run_and_stage(spark, tmpdir_path):
    out = tmpdir_path + "/log"
    one = spark.range(5).agg(F.count("*").alias("windows"), F.sum("id").alias("conflicts"))
    for run, stage in (("r1", "rewrite"), ("r1", "rewrite"), ("r1", "tag"), ("r2", "rewrite")):
        IO.log_metrics(one, out, run, stage)
    log = IO.read_metrics(spark, out, "windows long, conflicts long").collect()
    assert sorted((r["run"], r["stage"], r["windows"], r["conflicts"]) for r in log) == [
        ("r1", "rewrite", 5, 10), ("r1", "tag", 5, 10), ("r2", "rewrite", 5, 10)]
