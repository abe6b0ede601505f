"""Toxic passages by maximum-scoring segments (operator 10).

Token scores are log-odds of toxic against clean labelled text with an
informative Dirichlet prior (Monroe, Colaresi and Quinn 2008), of the token and
of its beginnings and endings of 4 to 7 characters.  Significance is the signed
root of the log-likelihood ratio (Dunning 1993) of the plain counts, in units of
a standard normal: a count of 0 in one class is evidence like any other, where a
variance of log-odds would grow with it.  The most significant of
them (counted over tokens not significant themselves) scores a token that is not significant itself, so inflected and unseen forms of a known stem count.
Tokens without a significant difference score nothing, and every token pays a
drift that makes the expected score negative.  One linear scan (Ruzzo and Tompa 1999) over a
whole text finds all its maximal scoring segments.  Their significance follows
the extreme-value law of such segments (Karlin and Altschul 1990): with n
tokens a score of S is expected K n exp(-lambda S) times in clean text.  lambda
comes from the score distribution of clean tokens, K from the clean labelled
documents, and a logistic curve over the log of the document's expectation,
fitted on the same rows, gives the score.

The labelled rows are a bounded sample (``BOUND``); the token table is counted
by Spark and only its ``VOCABULARY`` most significant rows are sent to tasks.

Defined results: null, empty and wordless texts have no passage and get the
score of an expectation of one; without labelled rows of both classes every
score is 0; repeated rows are scored each; a null doc_id is not held out; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read, stage, words_of
from detflow.llm.labelled import fold, training_texts

BOUND = 20_000              # labelled rows the model is fitted on
VOCABULARY = 50_000         # rows of the token table sent to tasks
PRIOR = 500.0               # weight of the prior, in distinct tokens of each class
SMOOTH = 0.5                # of the prior, for every token
MIN_Z = 4.0                 # least signed root of a token's log-likelihood ratio
AFFIXES = range(4, 8)       # characters of the beginnings and endings
DRIFT = 0.25                # what every token costs
MIN_EFFECT = 1.5            # least size of a scoring token's log-odds
MAX_EXPECTED = 0.05         # a passage is significant up to this expectation
FLOOR = -12.0               # log expectations are cut here


class Scores(dict):
    """Word bytes to log-odds, from the (log-odds, z) of features.  Looked-up
    words are kept, up to a bound."""

    def __init__(self, features: dict[str, tuple[float, float]]):
        super().__init__()
        self.features = features

    def __reduce__(self):
        return Scores, (self.features,)

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        names = features_of(word.decode())
        known = [self.features[f] for f in (names[:1] if names[0] in self.features else names) if f in self.features]
        score = max(known, key=lambda x: abs(x[1]))[0] if known else 0.0
        self[word] = score
        return score


def features_of(word: str) -> list[str]:
    """A token, its beginnings (^) and its endings ($)."""
    return [word, *("^" + word[:n] for n in AFFIXES if len(word) >= n), *("$" + word[-n:] for n in AFFIXES if len(word) >= n)]


@dataclass
class Model:
    scores: Scores = field(default_factory=lambda: Scores({}))
    rate: float = 1.0                               # lambda
    k: float = 1.0
    intercept: float = -100.0
    slope: float = 0.0

    def log_expected(self, score: float, n: int) -> float:
        """Log of the expected number of such segments, at most 0."""
        return max(FLOOR, min(0.0, math.log(self.k * max(n, 1)) - self.rate * score)) if score > 0 else 0.0

    def probability(self, log_expected: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * log_expected))))


def segments(tokens: list[bytes], scores: Scores) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, end) of a token list.
    Only tokens that score above the drift can begin one, so the scan visits
    those and takes what lies between from prefix sums.  Each segment knows the
    nearest earlier one with a smaller sum before it, so none is visited again
    by a search that it cannot end: time grows with the tokens."""
    if not tokens or not scores.features:
        return []
    sums = np.concatenate([[0.0], np.cumsum(np.array([scores[t] for t in tokens]) - DRIFT)])
    found: list[tuple[float, float, int, int, int]] = []    # (sum before, sum after, first, end, nearest smaller)
    for i in np.flatnonzero(np.diff(sums) > 0):
        before, after, first, end = float(sums[i]), float(sums[i + 1]), int(i), int(i) + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= after:
                found.append((before, after, first, end, j))
                break
            before, _, first, _, smaller = found[j]
            del found[j:]
            j = smaller
    return [(after - before, first, end) for before, after, first, end, _ in found]


def count_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, label to (word, toxic, clean) of each batch: in how many
    texts of each label a word stands, so one text's repeats count once."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[label].update(set(words_of(text.as_py())))
        vocabulary = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(vocabulary, pa.binary()), pa.array([counts[1][w] for w in vocabulary], pa.int64()),
             pa.array([counts[0][w] for w in vocabulary], pa.int64())], ["word", "toxic", "clean"])


def score_shares(batches: Iterable[pa.RecordBatch], scores: Scores) -> Iterator[pa.RecordBatch]:
    """Columns word, clean count to (score in hundredths, clean count)."""
    for batch in batches:
        at: Counter = Counter()
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at[round(100 * scores[word])] += n
        yield pa.RecordBatch.from_arrays([pa.array(at.keys(), pa.int64()), pa.array(at.values(), pa.int64())], ["score", "n"])


def best_segments(batches: Iterable[pa.RecordBatch], scores: Scores) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(max((s for s, _, _ in segments(w, scores)), default=0.0), len(w))
                for w in (words_of(t.as_py()) for t in batch.column(0))]
        best, n = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), batch.column(1)],
                                         ["best", "n", "label"])


def rate_of(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(rate * values)) = 1."""
    if not (values > 0).any():
        return 1.0
    low, high = 0.0, 50.0 / float(values.max())
    for _ in range(100):
        middle = (low + high) / 2
        if float((shares * np.exp(np.minimum(middle * values, 700))).sum()) > 1:
            high = middle
        else:
            low = middle
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps on a slightly smoothed likelihood."""
    w = np.zeros(2)
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def signed_root(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Root of the log-likelihood ratio of a token's counts against the shares of
    both classes, negative where it is rarer in toxic text."""
    share = all_toxic / (all_toxic + all_clean)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((toxic + clean) * p))).otherwise(0.0)
    ratio = F.greatest(2 * (part(toxic, share) + part(clean, 1 - share)), F.lit(0.0))
    return F.sqrt(ratio) * F.when(toxic * all_clean < clean * all_toxic, -1).otherwise(1)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5,
        held_out: int = 0, bound: int = BOUND) -> Model:
    """The model of a bounded labelled sample (see the module's text)."""
    texts = stage(spark, training_texts(spark, docs, labels, label_col, modulus, held_out, bound), "labelled-texts")
    table = stage(spark, texts.mapInArrow(count_tokens, "word binary, toxic long, clean long")
                  .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tokens")
    toxic, clean = table.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return Model()
    prior = (F.col("toxic") + F.col("clean")) * (PRIOR / (toxic + clean)) + SMOOTH
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (toxic + PRIOR - a)) - F.log(b / (clean + PRIOR - b))
    z = signed_root(F.col("toxic"), F.col("clean"), toxic, clean)
    significant = (F.abs(z) >= MIN_Z) & (F.abs(odds) >= MIN_EFFECT)
    word = F.col("feature")
    tokens = table.withColumn("feature", F.col("word").cast("string"))
    affixes = [F.when(F.length(word) >= n, F.concat(F.lit(mark), part)) for n in AFFIXES
               for mark, part in (("^", F.left(word, F.lit(n))), ("$", F.right(word, F.lit(n))))]
    parts = (tokens.where(~significant)
             .select(F.explode(F.array_compact(F.array(*affixes))).alias("feature"), "toxic", "clean")
             .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    rows = (tokens.select("feature", "toxic", "clean").unionByName(parts).where(significant)
            .select("feature", odds.alias("score"), z.alias("z")).orderBy(F.abs("z").desc(), "feature").limit(VOCABULARY).collect())
    scores = Scores({r["feature"]: (r["score"], r["z"]) for r in rows})      # at most VOCABULARY rows
    model = Model(scores)
    bins = table.select("word", "clean").mapInArrow(lambda x: score_shares(x, scores), "score long, n long")
    bins = np.array(bins.groupBy("score").agg(F.sum("n")).collect(), float)  # a row per hundredth of a score
    # one clean token more at the highest score keeps lambda finite where clean text has none
    top = max([x for x, _ in scores.features.values()], default=0.0)
    values, n = np.append(bins[:, 0] / 100, top), np.append(bins[:, 1], 1.0)
    model.rate = rate_of(values - DRIFT, n / n.sum())
    best = np.array(texts.mapInArrow(lambda x: best_segments(x, scores), "best double, n long, label int").collect(), float)
    best = best.reshape(-1, 3)                                    # at most `bound` rows
    own = best[best[:, 2] == 0]
    model.k = 1.0 / max(float(np.mean(np.maximum(own[:, 1], 1) * np.exp(-model.rate * own[:, 0]))), 1e-9)
    x = np.array([model.log_expected(s, int(n)) for s, n, _ in best])
    model.intercept, model.slope = logistic(x, best[:, 2])
    return model


def score_rows(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Column 0 text; the others are passed on, with the score and passages."""
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    for batch in batches:
        score, passages = [], []
        for text in batch.column(0):
            tokens = words_of(text.as_py())
            found = segments(tokens, model.scores)
            logs = [model.log_expected(s, len(tokens)) for s, _, _ in found]
            score.append(model.probability(min(logs, default=0.0)))
            passages.append([{"first_word": a, "end_word": b, "score": s, "expected": math.exp(e)}
                             for (s, a, b), e in zip(found, logs) if e <= math.log(MAX_EXPECTED)])
        rest = batch.schema.names[1:]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array(passages, kind)],
                                         [*rest, "score", "passages"])


PASSAGES = "array<struct<first_word:bigint,end_word:bigint,score:double,expected:double>>"


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every row of ``docs``."""
    model = fit(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).mapInArrow(
        lambda b: score_rows(b, model), f"doc_id {id_type}, score double, passages {PASSAGES}")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, as they were."""
    model = fit(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)

    def kept(batches):
        for batch in batches:
            keep = [model.probability(min((model.log_expected(s, len(w)) for s, _, _ in segments(w, model.scores)), default=0.0)) < 0.5
                    for w in (words_of(t.as_py()) for t in batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(kept, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
