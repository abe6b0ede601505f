"""Driver tables and the derived corpus views every operator reads.

The reference reads one wide two-speaker CSV; here the corpus is derived from
the given ``conversations`` and ``documents`` tables (definitions in
FIXTURES.md §2), so all work grows with those tables.  Every view is a lazy
DataFrame; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.draws import h
from detflow.functions.tagger import tag_tokens

# Fixed values of the study design.
BAND_EDGES = [0, 14, 18, 22, 26, 30, 34, 38, 42, 46, 50, 54, 58]   # bin edges (lo, hi]
BAND_LIMITS = BAND_EDGES[1:]                                      # 14 .. 58
VARIANTS = [(0, 0.0), (25, 0.25), (50, 0.5), (75, 0.75), (100, 1.0)]  # model_type, share kept both
UNFILTERED = 100


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def age_of(id_col) -> F.Column:
    """Stand-in child age: NULL for one id in 29, else 10, 14, ..., 62 months."""
    return (F.when(id_col % 29 == 28, F.lit(None))
            .otherwise(F.lit(10) + F.lit(4) * (id_col % 14))).cast("double")


def indexed_names(names: DataFrame) -> DataFrame:
    """``names`` (name) with a dense index idx, 0..n-1, in seeded order."""
    from detflow.operators.ranking import dense_index
    return dense_index(names, [], order_hash=h("name", F.lit("names")), tiebreak="name", out="idx")


class Corpus:
    """Lazy views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- sources -------------------------------------------------------
    @cached_property
    def texts(self) -> DataFrame:
        """(k, id, turn, role, text): conversation turns + documents."""
        conv = self.table("conversations").select(
            F.lit("c").alias("k"), F.col("conv_id").alias("id"), F.col("turn"),
            F.col("role"), F.col("text"))
        docs = (self.table("documents").select(
            F.lit("d").alias("k"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
            F.lit("assistant").alias("role"), F.col("text")))
        return conv.unionByName(docs)

    @cached_property
    def utterances(self) -> DataFrame:
        """One row per sentence with a stable uid and sortable source key."""
        s = self.texts.select(
            "k", "id", "turn", "role",
            F.posexplode(F.split(F.col("text"), T.SENTENCE_SPLIT, -1)).alias("sent_no", "s"))
        s = s.select("k", "id", "turn", "role", "sent_no", F.trim("s").alias("utt")).where(F.col("utt") != "")
        return s.select(
            F.concat_ws("-", "k", F.col("id").cast("string"), F.col("turn").cast("string"),
                        F.col("sent_no").cast("string")).alias("uid"),
            "k", "id", "turn", F.col("sent_no").cast("bigint").alias("sent_no"), "role", "utt",
            age_of(F.col("id")).alias("age_months"),
            (F.col("id") % 20).alias("subject"))

    @cached_property
    def raw_corpus(self) -> DataFrame:
        """Utterances with cleaning markers injected (MASK, [xN], &dddd, @, +, an).
        Texts that are only a marker are rows of their own (uid + ``-m``) beside
        the sentence; no sentence is replaced."""
        m = F.col("_m")      # drawn once a sentence
        text = (F.when(m == 2, F.concat("utt", F.lit(" MASK")))
                .when(m == 3, F.concat("utt", F.lit(" [x3]")))
                .when(m == 4, F.concat("utt", F.lit(" &8217s joe@x")))
                .when(m == 5, F.concat("utt", F.lit(" an An AN a+b")))
                .otherwise(F.col("utt")))
        own = F.struct("uid", text.alias("utt"))
        marker = F.struct(F.concat("uid", F.lit("-m")).alias("uid"),
                          F.when(m == 0, F.lit("MASK")).otherwise(F.lit("MASK MASK")).alias("utt"))
        rows = self.utterances.withColumn("_m", h("uid", F.lit("m")) % 20).withColumn("_row", F.explode(F.when(m < 2, F.array(own, marker)).otherwise(F.array(own))))
        return rows.withColumns({"uid": F.col("_row.uid"), "utt": F.col("_row.utt")}).drop("_row", "_m")

    @cached_property
    def tagged(self) -> DataFrame:
        """T1 + T8: utterances with ``tagged`` ARRAY<STRUCT<word,pos>>."""
        return self.utterances.withColumn("tagged", tag_tokens(T.tokens("utt")))

    @cached_property
    def parent(self) -> DataFrame:
        """Child-directed (assistant) sentences with a known age."""
        return self.tagged.where((F.col("role") == "assistant") & F.col("age_months").isNotNull())

    @cached_property
    def child(self) -> DataFrame:
        """Child (user) sentences with a known age."""
        return self.tagged.where((F.col("role") == "user") & F.col("age_months").isNotNull())

    @cached_property
    def names(self) -> DataFrame:
        """First-name stand-in: nation names with a dense index 0..n-1."""
        return indexed_names(self.table("nation").select(F.col("n_name").alias("name")))

    def bands(self) -> DataFrame:
        rows = [(lo, hi) for lo, hi in zip(BAND_EDGES[:-1], BAND_EDGES[1:])]
        return self.spark.createDataFrame(rows, "band_lo int, band_hi int")

    def variants(self) -> DataFrame:
        return self.spark.createDataFrame(VARIANTS, "model_type int, share double")
