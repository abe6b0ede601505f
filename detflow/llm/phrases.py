"""Substring dedup by repeated-phrase automata (operator 11).

A window is ``WINDOW`` consecutive words; windows that start in two places at
least recur, and the words they cover are removed.

Anchors.  The anchor of a window is its smallest word 8-gram by hash, the first
of equal ones.  Equal windows have equal anchors at equal offsets, so only
windows with one anchor are ever compared.  Neighbouring windows mostly share an
anchor: the stretch of words under all windows of one anchor is a segment (at
most 62 words, about 48).  Equal texts are one text with a weight, equal
segments of one anchor are one segment with a weight, both by partial
aggregates, so copies and common passages shrink before they are shuffled.

Confirming.  A segment of weight two recurs as a whole.  Where an anchor has
several segments, the weights of its windows are summed by 128 bits of hash, and
runs of recurring windows inside a segment are the recurring phrases.

Automata.  The phrases are dealt to shards by anchor.  A shard's phrases are
compiled into one Aho-Corasick automaton over their words (each word of a shard
has a code of two letters, one of each of two alphabets, so that matches
begin and end at words), and the distinct segments of the shard's anchors are
streamed through it.  What it finds, word by word, goes back to all
texts that hold the segment.  A shard has a bounded number of segments; an
anchor with more gets blocks of its own, each block of segments streamed through
each block of phrases.

Defined results: null and empty texts have no words; texts below ``WINDOW``
words lose nothing; repeated rows are copies and lose their windows; white space
between kept words becomes one space where a digest is taken; texts of any
length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read, remove_tables, stage

WINDOW = 35
GRAM = 8
SHARD_SEGMENTS = 4096       # of a shard, on average; an anchor with more gets blocks
WORDS_AT_ONCE = 1 << 16
MIX = np.uint64(0xBF58476D1CE4E5B9)
FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93      # of grams; of windows and segments


# ---------------------------------------------------------------- hashes of word sequences
class Powers:
    """Powers of an odd factor and of its inverse, modulo 2 ** 64."""

    def __init__(self, factor: int):
        self.bases = factor, pow(factor, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << n.bit_length()
            self.tables = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in self.bases]
        return [t[:n] for t in self.tables]


POWERS = [Powers(f) for f in FACTORS]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Sequences:
    """Hashes of any stretch of a text's words."""

    def __init__(self, words: list[bytes]):
        h = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE))])
        self.n = len(h)
        self.sums = [np.r_[np.uint64(0), np.cumsum(h * p.upto(self.n)[0], dtype=np.uint64)] for p in POWERS]

    def hash(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        out = (self.sums[which][start + length] - self.sums[which][start]) * POWERS[which].upto(self.n + 1)[1][start]
        out ^= out >> np.uint64(31)
        out *= MIX
        return out ^ (out >> np.uint64(29))


def anchors(seq: Sequences, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: hash, first window, number of windows."""
    if seq.n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = seq.hash(0, np.arange(seq.n - gram + 1), gram)
    best, at, wide, span = grams, np.arange(len(grams)), 1, window - gram + 1
    while wide < span:
        step = min(wide, span - wide)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        wide += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]], first, np.diff(np.r_[first, len(at)])


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def utf8(text: pa.StringScalar) -> bytes:
    """The bytes of a text as they lie in its batch; null: none."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


OCCURRENCES = "key binary, anchor array<long>, at array<int>, windows array<int>, segment array<long>"


def occurrence_rows(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Columns key, text to a row per text with its anchors in order."""
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for text in batch.column(1):
            seq = Sequences(utf8(text).split())
            anchor, first, count = anchors(seq, window, gram)
            segment = seq.hash(1, first, count + window - 1)
            for out, values in zip(columns, (signed(anchor), first, count, signed(segment))):
                out.append(values)
        types = pa.int64(), pa.int32(), pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, types))],
                                         ["key", "anchor", "at", "windows", "segment"])


SEGMENTS = "anchor long, segment long, windows int, weight long, variants long, words binary, hashes array<long>"


def segment_rows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Columns text, segments (lists of structs) to a row per segment with its
    words, and, where its anchor has other segments, the hashes of its windows."""
    for batch in batches:
        rows: list[tuple] = []
        each = batch.column(1).flatten()
        wanted = zip(*(each.field(c).to_pylist() for c in ("anchor", "segment", "windows", "weight", "variants", "at")))
        for text, some in zip(batch.column(0), batch.column(1).value_lengths().to_pylist()):
            words, seq = utf8(text).split(), None
            for anchor, segment, n, weight, variants, at in islice(wanted, some):
                if variants > 1 and seq is None:
                    seq = Sequences(words)
                hashes = signed(seq.hash(1, np.arange(at, at + n), window)) if variants > 1 else None
                rows.append((anchor, segment, n, weight, variants, b" ".join(words[at:at + n + window - 1]), hashes))
            if len(rows) > 20_000:
                yield _segments(rows)
                rows = []
        yield _segments(rows)


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      ["anchor", "segment", "windows", "weight", "variants", "words", "hashes"])


def runs(words: bytes, recurring: list[int], window: int) -> Iterator[bytes]:
    """The words under each run of recurring windows (numbers within a segment)."""
    split, at = words.split(b" "), np.sort(np.array(recurring, np.int64))
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        yield b" ".join(split[run[0]:run[-1] + window])


# ---------------------------------------------------------------- automata
class Codes(dict):
    """Words to two letters of different alphabets.  The first is one of ``BASE``, so that no
    place of an automaton has many ways on; the second has room for some 280 million words."""
    BASE = 256
    NONE = "\x01\x01"

    def add(self, word: bytes) -> str:
        code = self.get(word)
        if code is None:
            n = len(self)
            code = self[word] = chr(self.BASE + n % self.BASE) + chr(2 * self.BASE + n // self.BASE)
        return code

    def __missing__(self, word: bytes) -> str:
        return self.NONE


class Automaton:
    """Finds the words of a text that phrases cover."""

    def __init__(self):
        self.codes, self.found = Codes(), ahocorasick.Automaton()
        self.ready = False

    def add(self, phrase: bytes) -> None:
        words = phrase.split(b" ")
        self.found.add_word("".join(map(self.codes.add, words)), len(words))

    def spans(self, words: bytes) -> list[tuple[int, int]]:
        """Stretches (first, behind the last) of covered words, in order, apart."""
        if not self.ready:
            self.ready = True
            if len(self.found):
                self.found.make_automaton()
        if not len(self.found):
            return []
        out: list[tuple[int, int]] = []
        for end, length in self.found.iter("".join(map(self.codes.__getitem__, words.split(b" ")))):
            end = (end + 1) // 2
            start = end - length
            while out and out[-1][1] >= start:
                start = min(start, out.pop()[0])
            out.append((start, end))
        return out


LOCATED = "anchor long, segment long, windows int, spans array<struct<first:int,behind:int>>"


SHARD, SEGMENT = ["hot", "shard", "block", "lane"], ["source", "streamed", "anchor", "segment", "windows", "weight", "words", "recurring"]


def shard_spans(rows: list[tuple], window: int) -> Iterator[tuple]:
    """The rows (``SEGMENT``) of one shard: compile the phrases of its sources, then stream its texts."""
    automaton = Automaton()
    recurring = {r[2:5]: r[7] for r in rows if r[6] is None}
    texts = [r for r in rows if r[6] is not None]
    for source, _, *_, weight, words, _ in texts:
        if source and weight > 1:
            automaton.add(words)
    for r in texts:
        if r[0] and r[5] <= 1 and r[2:5] in recurring:
            for phrase in runs(r[6], recurring[r[2:5]], window):
                automaton.add(phrase)
    for r in texts:
        if r[1] and (spans := automaton.spans(r[6])):
            yield (*r[2:5], [{"first": a, "behind": b} for a, b in spans])


def locate(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_shards``, those of a shard together, to the covered words of its segments."""
    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                          ["anchor", "segment", "windows", "spans"])

    now, rows = None, []
    for batch in batches:
        out: list[tuple] = []
        shards, segments = (zip(*(batch.column(c).to_pylist() for c in names)) for names in (SHARD, SEGMENT))
        for shard, segment in zip(shards, segments):
            if shard != now:
                out += shard_spans(rows, window)
                now, rows = shard, []
            rows.append(segment)
        yield batch_of(out)
    yield batch_of(list(shard_spans(rows, window)))


def in_shards(spark: SparkSession, segments: DataFrame, recurring: DataFrame, shard_segments: int) -> DataFrame:
    """Segments, and window numbers of segments (``recurring``), with those of their
    shard.  A segment is a source of phrases and a text to stream; in the blocks of
    a hot anchor it is the source of one block, a text of one lane."""
    n_shards = max(1, -(-segments.count() // shard_segments))
    blocks = F.ceil(F.col("variants") / shard_segments).cast("int")
    hot = blocks > 1
    shard = F.when(hot, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    own = F.pmod(F.xxhash64("segment"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)

    def place(block: Column, lane: Column, source: Column, streamed: Column) -> Column:
        return F.struct(block.alias("block"), lane.alias("lane"), source.alias("source"), streamed.alias("streamed"))

    sources = F.transform(every, lambda i: place(own, i, F.lit(True), own == i))
    texts = F.transform(F.filter(every, lambda i: i != own), lambda i: place(i, own, F.lit(False), F.lit(True)))
    name = ["anchor", "segment", "windows"]
    rows = segments.select(hot.alias("hot"), shard.alias("shard"), F.explode(F.concat(sources, texts)).alias("p"), *name, "weight", "words",
                           F.lit(None).cast("array<int>").alias("recurring"))
    rows = rows.unionByName(recurring.select(
        hot.alias("hot"), shard.alias("shard"), F.explode(sources).alias("p"), *name, F.lit(None).cast("long").alias("weight"),
        F.lit(None).cast("binary").alias("words"), "recurring"))
    key = ["hot", "shard", "block", "lane"]
    rows = rows.select("hot", "shard", "p.*", *name, "weight", "words", "recurring")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)


# ---------------------------------------------------------------- the operator
def covered(spark: SparkSession, docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
            shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(key, spans): per distinct text, by the MD5 of the text, the stretches of
    words that lie under recurring windows; they may overlap."""
    texts = docs.select(F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = texts.mapInArrow(lambda b: occurrence_rows(b, window, gram), OCCURRENCES).where(F.size("anchor") > 0)
    rows = stage(spark, rows.groupBy("key").agg(F.count("*").alias("weight"), F.first(F.struct("anchor", "at", "windows", "segment")).alias("o"))
                 .withColumn("id", F.monotonically_increasing_id()), "anchors")
    each = rows.select("id", "weight", F.explode(F.arrays_zip("o.anchor", "o.at", "o.windows", "o.segment")).alias("o")).select("id", "weight", "o.*")
    shared = stage(spark, each.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").drop("n"), "shared-anchors")
    places = stage(spark, each.join(shared.hint("merge"), "anchor"), "places")
    name = ["anchor", "segment", "windows"]
    distinct = stage(spark, places.groupBy(*name).agg(F.sum("weight").alias("weight"), F.min(F.struct("id", "at")).alias("where")), "segments")
    variants = stage(spark, distinct.groupBy("anchor").agg(F.count("*").alias("variants")), "variants")
    wanted = (distinct.join(variants.hint("merge"), "anchor")
              .select(F.col("where.id").alias("id"), F.struct(*name, "weight", "variants", F.col("where.at").alias("at")).alias("x"))
              .groupBy("id").agg(F.collect_list("x").alias("wanted")).join(rows.select("id", "key").hint("merge"), "id"))
    one = texts.groupBy("key").agg(F.first("text").alias("text"))
    segments = stage(spark, one.join(wanted.hint("merge"), "key").select("text", "wanted")
                     .mapInArrow(lambda b: segment_rows(b, window), SEGMENTS), "segment-words")
    remove_tables(spark, shared, distinct, variants)
    # windows of anchors with several segments
    windows = segments.where("variants > 1").select(*name, "variants", "weight", F.posexplode("hashes").alias("i", "hash"))
    recurring = stage(spark, windows.groupBy("anchor", "hash").agg(F.sum("weight").alias("n")).where("n > 1").drop("n"), "recurring-windows")
    inside = (windows.where("weight = 1").select(*name, "variants", "i", "hash").join(recurring.hint("merge"), ["anchor", "hash"])
              .groupBy(*name, "variants").agg(F.collect_list("i").alias("recurring")))
    located = stage(spark, in_shards(spark, segments, inside, shard_segments).mapInArrow(lambda b: locate(b, window), LOCATED), "located")
    remove_tables(spark, segments, recurring)
    found = (places.select("id", "at", *name).join(located.hint("merge"), name)
             .select("id", F.explode(F.transform("spans", lambda s: F.struct(
                 (s["first"] + F.col("at")).alias("first"), (s["behind"] + F.col("at")).alias("behind")))).alias("span")))
    spans = found.groupBy("id").agg(F.collect_list("span").alias("spans")).join(rows.select("id", "key").hint("merge"), "id").drop("id")
    spans = stage(spark, spans, "covered")
    remove_tables(spark, rows, places, located)
    return spans


def kept_rows(batches: Iterable[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, spans to the words that stay, or their digest."""
    for batch in batches:
        total, removed, out = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            words = utf8(text).split()
            total.append(len(words))
            if spans.is_valid:
                stay, done = [], 0
                for first, behind in sorted((s["first"], s["behind"]) for s in spans.as_py()):
                    stay += words[done:first]
                    done = max(done, behind)
                words = stay + words[done:]
            kept = b" ".join(words)
            removed.append(total[-1] - len(words))
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])


def drop_phrases(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **sizes) -> DataFrame:
    """Every row with its kept words joined by one space, or their SHA-256."""
    spans = covered(spark, docs, text_col, **sizes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("key"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(spans.hint("merge"), "key", "left").select("doc_id", "text", "spans").mapInArrow(
        lambda b: kept_rows(b, digest), f"doc_id {id_type}, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_phrases(spark, read(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM s JOIN r USING (win)),
words AS (
  SELECT t.doc_id, p.i, p.word
  FROM t, LATERAL (SELECT unnest(w) AS word, generate_subscripts(w, 1) AS i) p),
marked AS (
  SELECT words.doc_id, words.i, word,
         max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = words.i)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(m.n, 0) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
                  FROM marked GROUP BY doc_id) m ON m.doc_id = t.doc_id
"""
