"""Line dedup by range-partitioned hashes (operator 8).

Every line long enough gives one row per document: the 128-bit hash of its
key, the document and the line numbers.  The rows are range-partitioned by
(hash, document, first line) and sorted within partitions, documents
descending, so the row that keeps its lines comes first and a hash with very
many documents spreads over as many partitions as it needs.  Tasks stream over
the sorted batches.  A hash that begins and ends inside a batch is decided
there; one that touches a batch's edge is decided by a count and a maximum
with map-side partials.  Texts do not take part: the result is a compressed
keep bitmap per document.

Defined results: null or empty text is one empty line; a null doc_id counts as
the smallest; repeated rows with one doc_id count as one document, and each
gets its own bitmap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read, stage

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 20
MIN_DOCUMENTS = 3
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def line_key(line: str) -> str:
    key = line.strip(WHITE)
    return key.lower() if key.isascii() else key.translate(LOWER)


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def line_rows(batches: Iterable[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, version, text to a row per document and line key."""
    for batch in batches:
        owner, high, low, lines, counts = [], [], [], [], []
        for i, text in enumerate(batch.column(2)):
            split = (text.as_py() or "").split("\n")
            at: dict[int, list[int]] = {}
            for k, line in enumerate(split):
                if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                    at.setdefault(xxhash.xxh3_128_intdigest(key.encode()), []).append(k)
            for h, numbers in at.items():
                owner.append(i)
                high.append(signed(h >> 64))
                low.append(signed(h & (1 << 64) - 1))
                lines.append(numbers)
                counts.append(len(split))
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(high, pa.int64()), pa.array(low, pa.int64()), batch.column(0).take(take),
             batch.column(1).take(take), pa.array(lines, pa.list_(pa.int32())), pa.array(counts, pa.int32())],
            ["high", "low", "doc_id", "version", "lines", "n_lines"])


def stream(batches: Iterable[pa.RecordBatch], min_documents: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by hash, then document descending: the rows that lose
    their lines (state 1), and all rows of hashes at a batch's edge (state 0)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        high, low = (batch.column(c).to_numpy() for c in (0, 1))
        new = np.ones(n, bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        docs = batch.column(2)
        doc = np.where(docs.is_null().to_numpy(zero_copy_only=False), -1, 0)
        code = docs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        other = new.copy()
        other[1:] |= (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        n_docs = np.bincount(run, other)
        since = np.cumsum(other) - np.cumsum(other)[first][run]      # 0: the document that keeps the line
        edge = (run == 0) | (run == run[-1])
        lost = ~edge & (n_docs[run] >= min_documents) & (since > 0)
        out = edge | lost
        kept = batch.filter(pa.array(out))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lost[out])], [*kept.schema.names, "lost"])


def bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, version, n_lines, lost line lists to a compressed bitmap."""
    for batch in batches:
        maps, dropped = [], []
        for n, lists in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[np.concatenate([np.array(x, np.int64) for x in lists])] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            ["doc_id", "version", "n_lines", "n_dropped", "keep_bitmap"])


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, keep_bitmap) of the documents that
    lose lines; ``version`` is the xxhash64 of the text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    row = f"high long, low long, doc_id {id_type}, version long, lines array<int>, n_lines int"
    rows = stage(spark, texts.mapInArrow(lambda b: line_rows(b, min_chars), row), "lines")
    order = ["high", "low", F.col("doc_id").desc_nulls_last(), F.col("lines")[0]]
    ordered = (rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
               .sortWithinPartitions(*order))
    found = stage(spark, ordered.mapInArrow(lambda b: stream(b, min_documents), row + ", lost boolean"), "runs")
    edges = found.where("NOT lost")
    # a null id sorts as the smallest, so it never is the largest id unless alone
    stats = stage(spark, edges.groupBy("high", "low").agg(
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"),
        F.max("doc_id").alias("keep")).where(F.col("n") >= min_documents), "edge-hashes")
    late = edges.join(stats.hint("merge"), ["high", "low"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lost = found.where("lost").select("doc_id", "version", "n_lines", "lines").unionByName(
        late.select("doc_id", "version", "n_lines", "lines"))
    per_doc = lost.groupBy("doc_id", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    return per_doc.mapInArrow(
        bitmaps, f"doc_id {id_type}, version long, n_lines int, n_dropped int, keep_bitmap binary")


def apply_bitmaps(batches: Iterable[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, n_lines, keep_bitmap to the kept text or its digest."""
    for batch in batches:
        n_lines, dropped, out = [], [], []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            bitmap = batch.column(2)[i].as_py()
            if bitmap is None:
                n, lost = text.count("\n") + 1, 0
            else:
                lines = text.split("\n")
                n, keep = len(lines), unpack(bitmap, len(lines))
                lost = n - int(keep.sum())
                text = "\n".join([x for x, k in zip(lines, keep) if k])
            n_lines.append(n)
            dropped.append(lost)
            out.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256" if digest else "text"])


def drop_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, digest: bool = False) -> DataFrame:
    """Every document with its kept lines, or with their SHA-256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    maps = stage(spark, keep_bitmaps(spark, docs, id_col, text_col, min_chars, min_documents), "bitmaps").select(
        F.col("doc_id").alias("m_id"), F.col("version").alias("m_version"), "keep_bitmap")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(maps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.xxhash64("text") == F.col("m_version")), "left")
    return joined.select("doc_id", "text", "keep_bitmap").mapInArrow(
        lambda b: apply_bitmaps(b, digest),
        f"doc_id {id_type}, n_lines long, n_dropped long, {'kept_sha256' if digest else 'text'} string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(spark, read(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS lost
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
