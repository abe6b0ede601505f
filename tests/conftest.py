import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from detflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="detflow-test-")


def tagged_df(spark, rows):
    """rows: list of (uid, [(word, pos), ...]) -> DataFrame(uid, tagged, k, id, turn, sent_no, age_months)."""
    data = [(u, [{"word": w, "pos": p} for w, p in t], "c", i, 0, 0, 20.0) for i, (u, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "uid string, tagged array<struct<word:string,pos:string>>, k string, id bigint, turn bigint, "
              "sent_no bigint, age_months double")
