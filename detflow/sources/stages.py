"""Stage tables of a run: columnar, laid out for the joins and filters that read them.

A stage is Parquet in the shared folder of the cluster.  ``bucket_by`` hashes its
rows into as many buckets as the session shuffles to, so joins and aggregations on
that column read it without an exchange (rows are not sorted, which their size would
make a spill of); ``partition_by`` makes
directories that filters prune.  Beside the data lies a manifest with the schema,
the layout and the row count, written last: a stage without one is not complete.
What was shuffled to write a stage goes when it is written, as later steps read the stage.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.session import ensure_checkpoint_dir

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_FILES = 8
CODEC = "zstd"
DEFAULTS = {WRITERS: "0", CLEANUP: "false"}


class Stages:
    def __init__(self, spark: SparkSession, name: str = "study", written: bool = True):
        """``written`` False: stages stay lazy, for tests of plans."""
        self.spark, self.written = spark, written
        self.run = uuid.uuid4().hex
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{self.run}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), bucket_by: str | None = None,
              derive=lambda rows: rows, replace: bool = False) -> DataFrame:
        """Write ``derive(df)`` once and return the stage that reads it.  ``derive``: a
        projection that is made after the rows are dealt to their buckets, so that
        columns larger than what they come from are not shuffled.  ``replace``: the stage
        takes the place of one of that name, which nothing reads any more."""
        if not self.written:
            return derive(df)
        path, n = f"{self.root}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"detflow_{name}_{self.run}"
        out = derive(df.repartition(n, bucket_by) if bucket_by else df)
        writer = out.write.format("parquet").option("path", path).option("compression", CODEC)
        if replace:
            writer = writer.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            writer = writer.bucketBy(n, bucket_by)
        with self._set({WRITERS: str(OPEN_FILES), CLEANUP: "true"}):
            writer.saveAsTable(table)
            stage = self.spark.table(table).select(*out.columns)
            self._manifest(stage, name, partition_by, bucket_by, n if bucket_by else 0)
        return stage

    def files(self, df: DataFrame, name: str, partition_by: list[str], form: str, codec: str) -> None:
        """Write ``df`` as compressed files of ``form`` below ``name``, a folder for each value of the keys,
        whose files follow its size; as with a stage, its shuffle goes when it is written."""
        writer = df.hint("rebalance", *partition_by).write.format(form).option("compression", codec)
        with self._set({CLEANUP: "true"}):
            writer.option("path", f"{self.root}/{name}").partitionBy(*partition_by).saveAsTable(
                f"detflow_{uuid.uuid4().hex}")

    @contextmanager
    def _set(self, settings: dict[str, str]):
        """WRITERS: tasks keep a file open for each directory and bucket that they have rows of, up
        to so many, and only past that are rows sorted: bucketed rows are in one bucket a task."""
        usual = {k: self.spark.conf.get(k, DEFAULTS[k]) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in usual.items():
                self.spark.conf.set(k, v)

    def _manifest(self, stage: DataFrame, name: str, partition_by, bucket_by, buckets: int) -> None:
        row = {"stage": name, "schema": json.loads(stage.schema.json()), "partition_by": list(partition_by),
               "bucket_by": bucket_by, "buckets": buckets, "rows": stage.count()}
        (self.spark.range(1).select(F.lit(json.dumps(row)).alias("value")).coalesce(1)
         .write.mode("overwrite").text(f"{self.root}/_manifest/{name}"))

    def manifest(self) -> DataFrame:
        """(stage, partition_by, bucket_by, buckets, rows) of the complete stages."""
        return self.spark.read.schema(
            "stage string, partition_by array<string>, bucket_by string, buckets int, rows long"
        ).json(f"{self.root}/_manifest/*")
