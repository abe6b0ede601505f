"""Spelling variants by FM-index search schemes over the vocabulary (operator 12).

Vocabulary.  Runs of letters are counted over all whole texts with map-side
partial sums; the words of enough code points and occurrences are kept.

Routing.  Two words at one edit agree on the code points before it and after it.
So, with m the length of the shorter, they share their first or their last
ceil((m - 1) / 2) code points.  A word goes to one shard for each such beginning
and ending that it can share (a shorter or an equally long partner: one or two
lengths a side), by the hash of (side, key): near words meet in a shard, no word
meets the whole vocabulary.  A shard holds many keys and is bounded; a key with
more words than a shard may hold is cut into blocks of words, and all its words
are searched in each block.

Index.  A shard's words, each between delimiters, form one text.  Its FM-index is
the Burrows-Wheeler transform with its symbols' places sorted by (symbol, place),
where one binary search gives the next suffix-rank interval.  Shards of
beginnings hold the index of the reversed text, which extends a match to the
right, shards of endings that of the text itself, which extends it to the left.

Search scheme.  Beginnings: the delimiter and the first half exactly, then the
other half with one inserted, deleted or replaced code point, then the
delimiter.  Endings: the mirror image.  The two searches together find every
word at one error; as neither has to change direction within a search, each
needs the intervals of one direction only.  All words of a shard are extended at
once; words with one beginning share its interval, and an interval's
continuations are read off once.  The last interval holds one word: its rank
gives the place in the text, and so the word.

Defined results: null and empty texts have no words; a null id counts as the
text ``null`` in the draw; repeated rows count again; among equally frequent
near words the smallest in code-point order is the form; runs of any length are
searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import ascii_lower, read, stage

NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
DRAW = 199
SHARD_WORDS = 4096      # words of a shard, on average; the most that share a key and stay whole


# ---------------------------------------------------------------- vocabulary
def delete_one(run: Column, doc_id: Column, draw: int) -> Column:
    """Where ``draw`` divides crc32 of ``<doc_id>:<run>``, the run loses a code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % draw == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT, draw: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters with enough code points and occurrences."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(ascii_lower(F.col(text_col)), NOT_LETTERS)).alias("run"))
    runs = runs.where(F.length("run") >= min_chars)
    word = F.col("run") if draw is None else delete_one(F.col("run"), F.col("id"), draw)
    return (runs.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


# ---------------------------------------------------------------- index of a shard
END, DELIMITER = 0, 1       # symbols; code points follow


def symbols(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64) + 2


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1]
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class Index:
    """FM-index of the delimited words; extends a match to the left."""

    def __init__(self, words: list[np.ndarray]):
        lengths = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(np.r_[1, lengths[:-1]])
        text = np.full(2 + lengths.sum(), DELIMITER, np.int64)
        text[-1] = END
        for s, w in zip(starts, words):
            text[s:s + len(w)] = w
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.keys = np.sort(self.bwt * (self.n + 1) + np.arange(self.n))      # places by (symbol, place)
        owner = np.full(self.n + 1, -1, np.int64)
        owner[starts] = np.arange(len(words))
        self.word = owner[order + 1]        # of a suffix at a delimiter: the word behind it

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = symbol * (self.n + 1)
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def continuations(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol), in order, of the letters before the suffixes of intervals."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        pair = np.unique(owner * (1 << 22) + self.bwt[place])
        owner, symbol = pair >> 22, pair & (1 << 22) - 1
        return owner[symbol > DELIMITER], symbol[symbol > DELIMITER]


class States:
    """Matches in progress: query and suffix-rank interval."""

    def __init__(self, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.query, self.low, self.high = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(3))

    def where(self, mask: np.ndarray) -> States:
        return States((self.query[mask], self.low[mask], self.high[mask]))

    def distinct(self) -> States:
        """Equal states once: in a periodic word an error at many places leads to the same match."""
        order = np.lexsort((self.high, self.low, self.query))
        query, low, high = self.query[order], self.low[order], self.high[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(query) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        return States((query[new], low[new], high[new]))

    def read(self, index: Index, symbol: np.ndarray) -> States:
        low, high = index.extend(symbol, self.low, self.high)
        return States((self.query, low, high)).where(high > low)


NOTHING = States(tuple(np.zeros(0, np.int64) for _ in range(3)))


def joined(*states: States) -> States:
    return States(*((s.query, s.low, s.high) for s in states))


def search(index: Index, reads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query, found word) at one edit behind a query's first half; ``reads``: the
    queries' symbols in the order in which they are read."""
    lengths = np.array([len(r) for r in reads])
    exact = (lengths - 1) // 2
    at = np.cumsum(np.r_[0, lengths[:-1] + 1])
    flat = np.concatenate([np.r_[r, DELIMITER] for r in reads])
    everything = States((np.arange(len(reads)), np.zeros(len(reads)), np.full(len(reads), index.n)))
    clean = everything.read(index, np.full(len(reads), DELIMITER))      # no error so far
    late, ended = NOTHING, [NOTHING]                                    # the error has happened; whole words
    for j in range(lengths.max() + 1):
        following = [NOTHING]
        here = clean.where(exact[clean.query] <= j)
        if len(here.query):
            there = flat[at[here.query] + j]
            # words with one beginning share an interval: its continuations are read off once
            spans, which = np.unique(here.low * (index.n + 1) + here.high, return_inverse=True)
            low, high = spans // (index.n + 1), spans % (index.n + 1)
            owner, symbol = index.continuations(low, high)
            low, high = index.extend(symbol, low[owner], high[owner])
            first = np.searchsorted(owner, np.arange(len(spans) + 1))
            count = np.diff(first)[which]
            s = np.repeat(np.arange(len(which)), count)
            k = np.arange(len(s)) + np.repeat(first[which] - np.cumsum(count) + count, count)
            more = States((here.query[s], low[k], high[k]))
            late = joined(late, more)                                                       # an inserted symbol
            following.append(more.where((there[s] > DELIMITER) & (symbol[k] != there[s])))  # a replaced one
            following.append(here.where(there > DELIMITER))                                 # a deleted one
        if len(late.query):
            symbol = flat[at[late.query] + j]
            last = symbol == DELIMITER
            ended.append(late.where(last).read(index, symbol[last]))
            following.append(late.where(~last).read(index, symbol[~last]))
        late = joined(*following).distinct()
        clean = clean.where(lengths[clean.query] > j)
        clean = clean.read(index, flat[at[clean.query] + j])
        if not len(clean.query) and not len(late.query):
            break
    whole = joined(*ended)
    return whole.query, index.word[whole.low]


def near_in_shard(words: list[str], queries: list[str], beginnings: bool) -> set[tuple[str, str]]:
    """(query, word) of all words at one edit that have the query's first half
    (``beginnings``), or its last."""
    order = 1 if beginnings else -1
    q, w = search(Index([symbols(x)[::-order] for x in words]), [symbols(x)[::order] for x in queries])
    return {(queries[a], words[b]) for a, b in zip(q.tolist(), w.tolist())}


# ---------------------------------------------------------------- routing
def routes(words: DataFrame, min_chars: int, shard_words: int) -> DataFrame:
    """(side, shard, to_q, to_w, word, n, query, target): where a word is looked for,
    and where it can be found."""
    length = F.length("word")
    half, less = F.floor(length / 2).cast("int"), F.when(length > min_chars, F.floor((length - 1) / 2).cast("int"))
    keys = F.array(*[F.struct(F.lit("b").alias("side"), F.substr(F.col("word"), F.lit(1), k).alias("key")) for k in (half, less)],
                   *[F.struct(F.lit("e").alias("side"), F.substr(F.col("word"), length - k + 1, k).alias("key")) for k in (half, less)])
    each = (words.select("word", "n", F.explode(F.array_distinct(keys)).alias("k")).where("k.key IS NOT NULL")
            .select("word", "n", "k.side", "k.key"))
    sizes = each.groupBy("side", "key").agg(F.ceil(F.count("*") / shard_words).cast("int").alias("blocks"))
    n_shards = max(1, -(-3 * words.count() // (2 * shard_words)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)

    def place(q: Column, w: Column, query: Column, target: Column) -> Column:
        return F.struct(q.alias("to_q"), w.alias("to_w"), query.alias("query"), target.alias("target"))

    places = F.concat(F.transform(blocks, lambda i: place(own, i, F.lit(True), own == i)),
                      F.transform(F.filter(blocks, lambda i: i != own), lambda i: place(i, own, F.lit(False), F.lit(True))))
    shard = F.when(F.col("blocks") > 1, F.concat(F.lit("="), F.col("key"))).otherwise(
        F.pmod(F.xxhash64("side", "key"), F.lit(n_shards)).cast("string"))
    return (each.join(sizes.hint("merge"), ["side", "key"]).select("side", shard.alias("shard"), "word", "n", F.explode(places).alias("p"))
            .select("side", "shard", "word", "n", "p.*"))


def near_words(spark: SparkSession, words: DataFrame, min_chars: int = MIN_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n), a row for each word at exactly one edit of another."""
    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(rows["word"], rows["n"]))
        targets, queries = (sorted(set(rows["word"][rows[c]])) for c in ("target", "query"))
        found = sorted(near_in_shard(targets, queries, key[0] == "b")) if targets and queries else []
        return pd.DataFrame({"word": np.array([a for a, _ in found], object), "near": np.array([b for _, b in found], object),
                             "near_n": np.array([n[b] for _, b in found], np.int64)})

    pairs = routes(words, min_chars, shard_words).groupBy("side", "shard", "to_q", "to_w").applyInPandas(
        group, "word string, near string, near_n long")
    return stage(spark, pairs.distinct(), "near-words")


def roots(spark: SparkSession, forms: DataFrame, longest: int) -> DataFrame:
    """(word, root): the end of each chain of forms, by doubling."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, longest - 1).bit_length()):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stage(spark, at.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def group_variants(spark: SparkSession, words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct
    words of at least ``min_chars`` code points; ``ratio`` over 1."""
    words = stage(spark, words, "vocabulary")
    pairs = near_words(spark, words, min_chars, shard_words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("form_n"),
                                     F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("form"))
    fits = F.col("form_n") >= ratio * F.col("n")
    out = stage(spark, words.join(best.hint("merge"), "word", "left").select(
        "word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    # a form is ``ratio`` times as frequent as its word, which bounds the chains
    longest, n = 0, words.agg(F.max("n")).first()[0] or 0
    while n >= ratio:
        longest, n = longest + 1, n // ratio
    ends = roots(spark, out.where("form IS NOT NULL"), longest)
    return (out.join(ends.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark, vocabulary(read(spark, sf_dir, "documents"), draw=DRAW))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
drawn AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                          ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
  FROM run, crc),
vocabulary AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM drawn GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocabulary b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, (list(near ORDER BY n DESC, near))[1] AS form FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * v.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 5 * v.n THEN b.form_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""
