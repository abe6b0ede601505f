"""Helpers shared by the corpus operators: input tables and stage tables.

A stage table is a Parquet table in the shared folder of the cluster
(``spark.checkpoint.dir``).  It cuts lineage, so a lost executor costs only the
tasks it ran, and it pins values such as row ids that a recomputation could
change.  Stage tables of a session are removed when its driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word characters of the contracts: everything but ASCII non-alphanumerics.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local master may go
    without one: it then gets a scratch folder of its own."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="detflow-stages-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001 - the driver's JVM has already gone
        return


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove stage tables that no later job reads."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(spark, path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove stage tables that nothing reads any more, and let Spark's cleaner
    drop the shuffle files of the jobs that have ended."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(spark, path)
    spark.sparkContext._jvm.System.gc()


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, version: xxhash64 of the
    text), one of each name, as they were."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    wanted = kept.select(name("doc_id").alias("__id"), F.col("version").alias("__version")).distinct()
    key = ["__id", "__version"]
    rows = docs.withColumn("__id", name(id_col)).withColumn("__version", F.xxhash64(text_col))
    return rows.join(wanted.hint("merge"), key, "left_semi").dropDuplicates(key).select(*docs.columns)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Lower-cased words of a text; null and wordless texts give an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), WORD_SEPARATORS, -1), "")


# Byte-wise counterparts for Arrow tasks: UTF-8 bytes over 0x7F are word bytes.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()
