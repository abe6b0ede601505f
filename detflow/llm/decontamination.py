"""Benchmark decontamination by a positional inverted index (operator 3).

DataFrame functions only.  The index holds the postings (term, row, position)
of every document word that occurs in the benchmark, as a stage table; each
document also has one posting without a term, whose position is its length.
Phrases (windows of benchmark words) are searched rarest term first: the
postings of the rarest term, less the term's offset, give candidate starts;
those of the second rarest are intersected with them; what is left is
intersected with the postings of all other terms in one equi-join.  A window
with a word that the corpus lacks is dropped before any posting is read.

Proximity matches use the same index: all terms of a phrase within a span of
``slop`` extra words of its rarest term's position.

Defined results: null text has no words; repeated rows are separate documents;
items with equal windows are all reported; items without words find nothing;
an empty table gives no rows, an empty benchmark no hits; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detflow.llm.common import read, stage, words

WINDOW = 10


class Index:
    """Postings of ``docs`` for the terms of a phrase table."""

    def __init__(self, spark: SparkSession, docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        """``phrases``: (phrase bigint, words array<string>), distinct words arrays."""
        self.spark = spark
        terms = stage(spark, phrases.select(F.explode("words").alias("word")).distinct()
                      .withColumn("term", F.monotonically_increasing_id()), "terms")
        rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                           F.concat(words(F.col(text_col)), F.array(F.lit(None).cast("string"))).alias("w"))
        each = rows.select("doc_id", "row", F.posexplode("w").alias("pos", "word"))
        known = each.join(terms, "word", "left").where(F.col("term").isNotNull() | F.col("word").isNull())
        self.table = stage(spark, known.select("doc_id", "row", "pos", "term"), "postings")
        self.documents = self.table.where("term IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        self.postings = self.table.where("term IS NOT NULL").select("term", "row", "pos")
        frequency = self.postings.groupBy("term").agg(F.count("*").alias("frequency"))
        parts = (phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
                 .join(terms, "word").join(frequency, "term")
                 .withColumn("present", F.count("*").over(Window.partitionBy("phrase"))).where("present = n")
                 .withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy("frequency", "offset"))))
        self.parts = stage(spark, parts.select("phrase", "n", "offset", "term", "rank"), "phrase-terms")

    def _starts(self, rank: int) -> DataFrame:
        part = self.parts.where(F.col("rank") == rank).select("phrase", "n", "offset", "term")
        return (self.postings.join(part, "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
                .select("row", "phrase", "start", "n"))

    def exact(self) -> DataFrame:
        """(row, phrase, start, n) of every place where a phrase stands."""
        key = ["row", "phrase", "start"]
        two = self._starts(1).join(self._starts(2).drop("n").hint("merge"), key)
        one = self._starts(1).where("n = 1")
        two = stage(self.spark, two, "candidates")
        rest = two.join(self.parts.where("rank > 2").select("phrase", "offset", "term"), "phrase")
        wanted = rest.select("row", (F.col("start") + F.col("offset")).alias("pos"), "term").distinct()
        missing = wanted.join(self.postings.hint("merge"), ["row", "pos", "term"], "left_anti")
        missing = stage(self.spark, missing, "missing")
        bad = (rest.join(missing.hint("merge"),
                         (rest["row"] == missing["row"]) & (rest["start"] + rest["offset"] == missing["pos"])
                         & (rest["term"] == missing["term"]))
               .select(rest["row"], rest["phrase"], rest["start"]).distinct())
        return two.join(bad, key, "left_anti").select(*key, "n").unionByName(one)

    def near(self, slop: int) -> DataFrame:
        """(row, phrase, pos) where every distinct term of a phrase lies at most
        n - 1 + slop words from a place of its rarest term."""
        rare = (self.postings.join(self.parts.where("rank = 1").select("phrase", "n", "term"), "term")
                .select("row", "phrase", "n", F.col("pos").alias("at")))
        wanted = self.parts.groupBy("phrase").agg(F.count_distinct("term").alias("terms"))
        others = self.parts.select("phrase", "term").distinct()
        hits = (rare.join(others, "phrase").join(self.postings.hint("merge"), ["row", "term"])
                .where(F.abs(F.col("pos") - F.col("at")) <= F.col("n") - 1 + slop))
        return (hits.groupBy("row", "phrase", "at").agg(F.count_distinct("term").alias("terms"))
                .join(wanted, ["phrase", "terms"]).select("row", "phrase", F.col("at").alias("pos")))


def windows(spark: SparkSession, items: DataFrame, item_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (phrase, words) and which items hold them."""
    w = F.col("w")
    each = (items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0)
            .select("item", F.explode(F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.slice(w, i, size))).alias("words")))
    phrases = stage(spark, each.groupBy("words").agg(F.collect_set("item").alias("items"))
                    .withColumn("phrase", F.monotonically_increasing_id()), "windows")
    return phrases.select("phrase", "words"), phrases.select("phrase", F.explode("items").alias("item"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted) of benchmark windows."""
    phrases, owners = windows(spark, items, item_col, item_text_col, size)
    index = Index(spark, docs, phrases, id_col, text_col)
    places = stage(spark, index.exact(), "places")
    spans = places.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hit = spans.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = hit.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "covered"), F.lit(0))).alias("n_hit"))
    found = (places.select("row", "phrase").distinct().join(owners, "phrase")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return (index.documents.join(n_hit.hint("merge"), "row", "left").join(found.hint("merge"), "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, as they were.  A row is
    named by its id, which may be null, and the xxhash64 of its text."""
    version = F.xxhash64("text")
    named = docs.select(F.struct(F.col(id_col).alias("id"), version.alias("version")).alias("name"), "text")
    hit = decontaminate(spark, named, items, "name").where("n_hit > 0").select(
        F.col("doc_id.id").alias("__hit"), F.col("doc_id.version").alias("__version")).distinct()
    hit = stage(spark, hit, "contaminated")
    return docs.join(hit.hint("merge"), F.col(id_col).eqNullSafe(F.col("__hit")) & (version == F.col("__version")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
