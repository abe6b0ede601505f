"""Readers and writers for the reference's file formats.

Every reader declares its schema (no inference); writers partition by the keys
the reference encodes in file names, so later reads prune partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CORPUS_SCHEMA = Ty.StructType([
    Ty.StructField("_index", Ty.LongType()), Ty.StructField("subject", Ty.StringType()),
    Ty.StructField("age_months", Ty.DoubleType()), Ty.StructField("p_utts", Ty.StringType()),
    Ty.StructField("c_utts", Ty.StringType())])
TAGGED_TYPE = "array<struct<word:string,pos:string>>"
# Fixed value: the name of a test set's file.
TEST_FILE_PATTERN = r"test_(\d+)_months_(\d+)\.txt"
BAND_PATH_PATTERN = r"model_type=(\d+)/band_hi=(\d+)/[^/]+$"


def _csv_reader(spark: SparkSession, schema, header: bool, multi_line: bool):
    """Quote and escape '"', white space kept.  Without ``multi_line`` a record is one
    line and a large file is split among tasks; with it a file is one task, so it is
    only for files whose quoted fields hold line breaks."""
    reader = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", True) if multi_line else reader.option("lineSep", "\n")


def _csv_writer(df: DataFrame, header: bool):
    return (df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_corpus_csv(spark: SparkSession, path: str, schema: Ty.StructType = CORPUS_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Headed corpus CSV; the first column is an index and is dropped."""
    return _csv_reader(spark, schema, True, multi_line).csv(path).drop(schema.fieldNames()[0])


def write_corpus_csv(df: DataFrame, path: str, index: Column) -> None:
    """The layout of S1: ``index`` as the first column, then ``df``."""
    _csv_writer(df.select(index.alias("_index"), "*"), True).csv(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The ``Name`` column of a headed names CSV."""
    return spark.read.schema("Name string").option("header", True).csv(path).select(F.col("Name").alias("name"))


def write_names(names: DataFrame, path: str) -> None:
    _csv_writer(names.select(F.col("name").alias("Name")), True).csv(path)


def read_headerless(spark: SparkSession, path: str, names: list[str], types: list[str] | None = None,
                    multi_line: bool = False) -> DataFrame:
    """S3: headerless CSV with supplied column names (quote/escape '"')."""
    types = types or ["string"] * len(names)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return _csv_reader(spark, schema, False, multi_line).csv(path)


def decode_tagged(df: DataFrame, col: str = "tagged") -> DataFrame:
    """JSON-encoded list of (word, pos) -> ARRAY<STRUCT>; malformed -> []."""
    dec = F.from_json(F.col(col), TAGGED_TYPE, {"mode": "PERMISSIVE"})
    return df.withColumn(col, F.coalesce(dec, F.array().cast(TAGGED_TYPE)))


def encode_tagged(df: DataFrame, col: str = "tagged") -> DataFrame:
    return df.withColumn(col, F.to_json(F.col(col)))


def discover_test_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files named ``test_<age>_months_<model_type>.txt``, or directories named
    ``file=`` and that -> (age, model_type) from the name, plus their rows."""
    reader = spark.read.option("header", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path).withColumn("_path", F.col("_metadata.file_path"))
    name = "/(?:file=)?" + TEST_FILE_PATTERN + "(?:/[^/]+)?$"
    m = df.where(F.col("_path").rlike(name))
    return m.withColumn("age", F.regexp_extract("_path", name, 1).cast("int")) \
        .withColumn("model_type", F.regexp_extract("_path", name, 2).cast("int")).drop("_path", "file")


def write_test_files(df: DataFrame, path: str) -> None:
    """K3 by file name: the rows of an (age, model_type) as headed CSV under that name."""
    name = F.format_string("test_%d_months_%d.txt", F.col("age"), F.col("model_type"))
    rows = df.withColumn("file", name).drop("age", "model_type")
    (_partition_writer(rows, ["file"]).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def discover_bands(spark: SparkSession, path: str) -> DataFrame:
    """J9 + S6: the registry of trained bands, (model_type, age, files, bytes), from the
    files below ``path``; only names and sizes are read, no content.  A band without
    a file, or with empty files only, isn't trained; other files don't count."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    named = found.where(F.col("path").rlike(BAND_PATH_PATTERN)).select(
        F.regexp_extract("path", BAND_PATH_PATTERN, 1).cast("int").alias("model_type"),
        F.regexp_extract("path", BAND_PATH_PATTERN, 2).cast("int").alias("age"), "length")
    bands = named.groupBy("model_type", "age").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return bands.where("bytes > 0")


def read_band_text(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line; partition columns come from the directory."""
    return spark.read.text(path).withColumnRenamed("value", "utt")


def parse_decimal_comma(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values written with ',' as decimal mark -> DOUBLE (bad values NULL)."""
    for c in cols:
        df = df.withColumn(c, F.expr(f"try_cast(regexp_replace({c}, ',', '.') AS DOUBLE)"))
    return df


def write_headerless(df: DataFrame, path: str, codec: str = "none") -> None:
    """K1: headerless CSV export (nested columns JSON-encoded).  A file compressed by ``codec`` is
    read by one task, so it is for data in many files."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (Ty.ArrayType, Ty.StructType, Ty.MapType)):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    _csv_writer(out, False).option("compression", codec).csv(path)


def _partition_writer(df: DataFrame, keys: list[str]):
    """A writer that replaces the partitions it has rows for and leaves the others.
    Rows are rebalanced by the keys first: a partition's rows come from one task,
    or, where they are more than AQE's advisory size, from one for each such part,
    so its files are bounded by its size and not by the number of map tasks."""
    return (df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys))


def write_age_bands(bands: DataFrame, path: str) -> None:
    """K2: utterance text only, one directory per (model_type, band_hi)."""
    _partition_writer(bands.select("model_type", "band_hi", "utt"), ["model_type", "band_hi"]).text(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """K3/K4/K6: Parquet partitioned by the keys the reference puts in file names."""
    _partition_writer(df, keys).parquet(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """K5: a small result table (<= a few hundred rows) as one headed CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_metrics(df: DataFrame, name: str, conflict_col: str | None = None) -> tuple[DataFrame, Observation]:
    """K7: observe row (and conflict) counts while the job runs; no extra pass."""
    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")]
    if conflict_col:
        exprs.append(F.count_if(F.col(conflict_col)).alias("conflicts"))
    return df.observe(obs, *exprs), obs


def log_metrics(metrics: DataFrame, path: str, run: str, stage: str) -> None:
    """K7: the metrics row of a stage in the run log.  The log is partitioned by run
    and stage and a partition is replaced, so logging again adds no row."""
    row = metrics.withColumns({"run": F.lit(run), "stage": F.lit(stage)})
    write_partitioned(row, path, ["run", "stage"])


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The run log: the metrics columns of ``schema``, run and stage."""
    return spark.read.schema(f"{schema}, run string, stage string").parquet(path)
