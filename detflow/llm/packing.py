"""Best-fit packing with Martello-Toth dominance reduction (operator 1).

Only lengths decide a packing and a length is at most the capacity, so the
whole instance is a histogram of at most ``capacity`` counts, whatever the
corpus holds.  The histogram goes to the driver; documents never do.

1. Executors tokenise whole texts and cut the longer ones into pieces.  Each
   piece is numbered among its task's pieces of that length, so a rank within
   a length needs no sort and no shuffle of texts.
2. On the histogram, sets that dominate every alternative for one of their
   members are fixed for good (Martello and Toth 1990), which shrinks the
   instance; best-fit decreasing packs the rest, run-length over equal bins.
3. The packing is a list of runs (length, ranks, first sequence, offset); each
   piece finds its run by its rank within its length.

Defined results: null or empty text is one piece holding only the end token;
repeated rows are separate documents (same doc_id); a null doc_id is kept; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detflow.llm.common import read, stage

CAPACITY = 1024
END_TOKEN = 2
VOCABULARY = "byte_bpe_50k.tiktoken"     # the vocabulary of byte_bpe_50k.json as ranks
ADDED = "byte_bpe_50k.json"              # declares the added tokens


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The public byte-level BPE with the added tokens of its JSON, which stand
    for themselves wherever a text holds their string."""
    import json

    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(ADDED), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; a short piece comes first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int, end_token: int,
             with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).encode
    seen = np.zeros(capacity + 1, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        rows, ids_out, docs = [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = np.array(encode(text.as_py() or "", allowed_special="all") + [end_token], "<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                piece = ids[start:start + length]
                rows.append((k, start, length, zlib.crc32(piece.tobytes()), seen[length]))
                seen[length] += 1
                docs.append(i)
                if with_ids:
                    ids_out.append(piece)
        table = np.array(rows, np.int64).reshape(-1, 5)
        arrays = [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(table[:, 0].astype(np.int32)),
                  *(pa.array(table[:, c]) for c in (1, 2, 3)),
                  pa.array(np.full(len(table), part, np.int32)), pa.array(table[:, 4])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
        if with_ids:
            arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def _previous(counts: np.ndarray) -> np.ndarray:
    """At n: the largest length up to n that has documents left, else 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    """The n smallest lengths left, with multiplicity."""
    out: list[int] = []
    for length in np.flatnonzero(counts):
        out += [int(length)] * int(min(n - len(out), counts[length]))
        if len(out) == n:
            break
    return out


def dominating(counts: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of a document of this length that dominate every other
    feasible set of companions, or None where no set up to two is proven to.

    A set dominates another when the other's members can be split into groups
    that each fit under one member of the first."""
    rest, room = counts.copy(), capacity - length
    rest[length] -= 1
    before = _previous(rest)
    largest = int(before[room])
    if not largest:
        return ()                       # nothing fits beside it
    if largest == room:
        return (largest,)               # whatever else fits beside it fits in that one's place
    low = _smallest(rest, 3)
    if len(low) < 2 or low[0] + low[1] > room:
        return (largest,)               # one companion at most: the largest is best
    if len(low) == 3 and sum(low) <= room:
        return None
    rest[largest] -= 1
    second = int(_previous(rest)[room - largest])
    if not second:
        return None
    for x in np.flatnonzero(rest[: largest + 1]):
        y = int(before[min(x, room - x)])
        if y > second and x + y > largest:
            return None
    return (largest, second)


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fix dominating sets, taking them out of ``counts``: (bins, lengths)."""
    fixed: list[tuple[int, list[int]]] = []
    again = True
    while again:
        again = False
        for length in range(capacity, 0, -1):
            while counts[length] > 0:
                found = dominating(counts, length, capacity)
                if found is None:
                    break
                lengths, uses = [length, *found], {}
                for x in lengths:
                    uses[x] = uses.get(x, 0) + 1
                bins = min(int(counts[x]) // n for x, n in uses.items())
                for x, n in uses.items():
                    counts[x] -= bins * n
                fixed.append((bins, lengths))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over a histogram: (bins, lengths), equal bins once."""
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, lengths: list[int]) -> None:
        if bins:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((bins, lengths))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, left, [])
                continue
            room = rooms[at]
            bins, lengths = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, full, lengths + [length] * each)
            left -= full * each
            bins -= full
            if bins and left:
                put(room - left * length, 1, lengths + [length] * left)
                bins, left = bins - 1, 0
            put(room, bins, lengths)
    return [group for groups in open_bins.values() for group in groups if group[1]]


def plan(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, list[int]]], int]:
    """The packing of a histogram, and how many of its groups dominance fixed."""
    counts = counts.astype(np.int64).copy()
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity), len(fixed)


def runs(groups: list[tuple[int, list[int]]], capacity: int) -> np.ndarray:
    """Columns length, first rank, first sequence, offset; by length and rank."""
    used, out, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for bins, lengths in groups:
        offset = 0
        for length in lengths:
            out.append((length, used[length], sequence, offset))
            used[length] += bins
            offset += length
        sequence += bins
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def place(batches, table: np.ndarray):
    """Sequence and offset of each piece from its rank within its length."""
    bounds = np.searchsorted(table[:, 0], np.arange(table[-1, 0] + 2)) if len(table) else None
    for pdf in batches:
        length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
        at = np.empty(len(pdf), np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = bounds[n], bounds[n + 1]
            at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
        pdf["sequence_id"] = table[at, 2] + rank - table[at, 1]
        pdf["offset"] = table[at, 3]
        yield pdf


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_token: int = END_TOKEN,
         with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset; ``with_ids`` adds the
    token ids of each piece."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
              + (", ids array<long>" if with_ids else ""))
    pieces = stage(spark, docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        lambda batches: tokenise(batches, vocabulary, capacity, end_token, with_ids), schema), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():   # at most `capacity` rows
        counts[row["length"]] = row["n"]
    groups, _ = plan(counts, capacity)
    table = runs(groups, capacity)
    first = by_task.withColumn("first", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (pieces.join(first.drop("n"), ["length", "part"])
              .withColumn("rank", F.col("first") + F.col("local_rank"))
              .drop("first", "part", "local_rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    out = (f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
           + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long")
    return ranked.select(*columns, "rank").mapInPandas(lambda batches: place(batches, table), out)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"))
