"""Secret scan with corpus-wide ownership frequency (operator 2).

DataFrame functions only.  Spans come from splitting the text at a pattern: the
lengths of the pieces between the matches and of the matches give each start,
in code points.  Every candidate value is hashed; the hashes are counted over
documents, distinct repositories and distinct owners of the whole corpus (with
map-side partials).  A value of many owners is a copied example; a value of one
owner that looks random is a live credential.  Values without a known prefix or
keyword (kind ``generic``) are reported only when the counts say they belong to
one owner.

Defined results: null text counts as empty; repeated rows are scanned each; a
null owner or repository counts as one of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read, stage

# Fixed values: (kind, pattern, group holding the value, its least length,
# least length of the whole match), in the order that breaks ties of a start.
BASE_KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, 0),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 0, 32),
]
MORE_KINDS = [
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0, 40),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0, 30),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, 20),
    ("generic", r"[A-Za-z0-9+/_-]{24,}", 0, 0, 24),
]
KINDS = BASE_KINDS + MORE_KINDS
MIN_EXAMPLE_OWNERS = 3      # from so many distinct owners on a value is an example
MIN_ENTROPY = 3.0           # bits per character that a live-looking value has


def pattern_spans(text: Column, kind_no: int) -> Column:
    """array<struct<start,end,kind_no,value>> of one kind's valid matches."""
    _, pattern, group, min_value, min_total = KINDS[kind_no]
    regex = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind_no:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind_no).alias("kind_no"), x["value"].alias("value"))
        valid = (F.length(x["value"]) >= min_value) & (F.length(x["hit"]) >= min_total)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"),
                        F.when(valid, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(found, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def entropy(value: Column) -> Column:
    """Bits per character."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, c: acc - (F.size(F.filter(chars, lambda d: d == c)) / n) * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         repository_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",),
         min_example_owners: int = MIN_EXAMPLE_OWNERS) -> DataFrame:
    """Per row: ``spans`` array<struct<start,end,kind,value_hash,n_docs,
    n_repositories,n_owners,verdict>> ordered by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda cols: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols))
    rows = docs.select(F.col(id_col).alias("doc_id"), name(repository_cols).alias("repository"),
                       name(owner_cols).alias("owner"), text.alias("text"))
    spans = reduce(F.concat, [pattern_spans(F.col("text"), k) for k in range(len(KINDS))])
    found = stage(spark, rows.select(
        "doc_id", "repository", "owner", F.monotonically_increasing_id().alias("row"),
        F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"),
            F.sha2(s["value"], 256).alias("value_hash"), entropy(s["value"]).alias("entropy"),
            s["value"].rlike("[0-9]").alias("digit"), s["value"].rlike("[A-Za-z]").alias("letter"))).alias("spans")), "spans")
    each = found.select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", "s.*")
    counts = stage(spark, each.groupBy("value_hash").agg(
        F.count_distinct("row").alias("n_docs"), F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners")), "ownership")
    looks_live = (F.col("entropy") >= MIN_ENTROPY) & F.col("digit") & F.col("letter")
    verdict = (F.when(F.col("n_owners") >= min_example_owners, "example")
               .when((F.col("n_owners") == 1) & looks_live, "live").otherwise("unclear"))
    kind = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind_no") + 1)
    judged = each.join(counts.hint("merge"), "value_hash").withColumn("verdict", verdict).withColumn("kind", kind)
    judged = judged.where((F.col("kind") != "generic") | (F.col("verdict") == "live"))
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", "kind_no", "end", "kind", "value_hash", "n_docs", "n_repositories", "n_owners", "verdict"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return (found.select("row", "doc_id").join(per_row.hint("merge"), "row", "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark, read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return out.select(
        "doc_id", *(count(lambda s: s["kind"] == kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"))
