"""Exact dedup by composable polynomial fingerprints (operator 5).

A text without white space is a number in base B modulo two primes.  Chunk
hashes are independent of each other and combine by shifting the left one by
the length of the right one, so a huge document is hashed chunk by chunk in
bounded memory.  Documents of equal (fingerprint, length) are then compared
with their group's representative chunk by chunk; a group in which a
comparison fails is split by the SHA-256 of its texts.

Groups are only aggregated with map-side partials (count, best row) and joined
back as stage tables by sort-merge joins at every size (the sides grow with the
corpus, so none is broadcast), where adaptive execution splits a hot fingerprint.

Defined results: null text counts as empty; empty texts are one group; the row
with the most code points, then the smallest doc_id (null last), then any one
of repeated rows stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import keep_rows, read, stage

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
CHUNK = 1 << 16


class Fingerprint:
    """Polynomial fingerprints: ``of`` a text, ``combine`` for adjacent parts."""

    def __init__(self, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk = primes, chunk
        self.powers = []
        for p in primes:
            powers = np.ones(chunk, np.uint64)
            for i in range(1, chunk):
                powers[i] = int(powers[i - 1]) * BASE % p
            self.powers.append(powers[::-1].copy())

    def of_chunk(self, data: np.ndarray) -> tuple[int, int]:
        """Of at most ``chunk`` bytes: 2^16 terms under 2^39 fit in 64 bits."""
        wide = data.astype(np.uint64)
        return tuple(int(np.dot(wide, w[self.chunk - len(wide):])) % p for w, p in zip(self.powers, self.primes))

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        return tuple((a * pow(BASE, right_length, p) + b) % p for a, b, p in zip(left, right, self.primes))

    def of(self, data: bytes) -> tuple[int, int]:
        view, whole = np.frombuffer(data, np.uint8), (0, 0)
        for at in range(0, len(view), self.chunk):
            part = view[at:at + self.chunk]
            whole = self.combine(whole, self.of_chunk(part), len(part)) if at else self.of_chunk(part)
        return whole


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE)


def fingerprints(batches: Iterable[pa.RecordBatch], primes: tuple[int, int], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Columns (id, text, version) to id, version, code points, bytes,
    fingerprint, and either the SHA-256 or the normalised text."""
    prints = Fingerprint(primes)
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(1):
            text = text.as_py() or ""
            data = normalise(text)
            rows.append((len(text), len(data), *prints.of(data),
                         data if with_text else hashlib.sha256(data).hexdigest()))
        n, size, f1, f2, last = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(f1, pa.int64()),
             pa.array(f2, pa.int64()), pa.array(last, pa.binary() if with_text else pa.string())],
            ["doc_id", "version", "n_chars", "size", "f1", "f2", "body" if with_text else "text_sha256"])


def differing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns f1, f2, size, body, keep_body: the groups of rows whose text is
    not their representative's, compared chunk by chunk up to a difference."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            a, b = (memoryview(batch.column(c)[i].as_buffer()) for c in (3, 4))
            same = len(a) == len(b) and all(a[k:k + CHUNK] == b[k:k + CHUNK] for k in range(0, len(a), CHUNK))
            keep.append(not same)
        yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))


FINGERPRINT = ["f1", "f2", "size"]


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of ``docs`` with the row of its group that stays;
    ``version`` is the xxhash64 of the text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    common = f"doc_id {id_type}, version long, n_chars long, size long, f1 long, f2 long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("version"))
    prints = stage(spark, texts.mapInArrow(lambda b: fingerprints(b, primes, False), f"{common}, text_sha256 string")
                   .withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # the best row: most code points, then smallest id (a null id last), then first row
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    groups = stage(spark, prints.groupBy(*FINGERPRINT).agg(F.count("*").alias("n"), best).where("n > 1")
                   .select(*FINGERPRINT, F.col("best.doc_id").alias("best_id"),
                           (-F.col("best.col1")).alias("best_chars")), "groups")
    copies = stage(spark, texts.mapInArrow(lambda b: fingerprints(b, primes, True), f"{common}, body binary")
                   .join(groups.hint("merge"), FINGERPRINT)
                   .withColumn("is_best", F.col("doc_id").eqNullSafe(F.col("best_id"))
                               & (F.col("n_chars") == F.col("best_chars")))
                   .select(*FINGERPRINT, "is_best", "body"), "copies")
    reps = copies.where("is_best").groupBy(*FINGERPRINT).agg(F.first("body").alias("keep_body"))
    reps = stage(spark, reps, "representatives")
    clashes = (copies.join(reps.hint("merge"), FINGERPRINT).select(*FINGERPRINT, "body", "keep_body")
               .mapInArrow(differing, "f1 long, f2 long, size long").distinct())
    clashes = stage(spark, clashes, "clashes").withColumn("clash", F.lit(True))
    classed = (prints.join(clashes, FINGERPRINT, "left")
               .withColumn("split", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit(""))).drop("clash"))
    key = [*FINGERPRINT, "split"]
    kept = stage(spark, classed.groupBy(*key).agg(F.count("*").alias("group_size"), best).where("group_size > 1"),
                 "kept")
    out = classed.join(kept.hint("merge"), key, "left")
    single = F.col("best").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.row") == F.col("row"))).alias("kept"), "text_sha256", "version")


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, as they were."""
    kept = dedup(spark, docs, id_col, text_col).where("kept").select("doc_id", "version")
    return keep_rows(docs, stage(spark, kept, "kept-rows"), id_col, text_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, read(spark, sf_dir, "documents")).drop("version")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
