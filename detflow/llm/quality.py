"""Quality by nearest-neighbour votes over latent-semantic vectors (operator 9).

The terms of a text are the pairs of adjacent byte classes of its whole UTF-8
form (letters by case, digits, white space, each punctuation mark by itself,
other letters), and buckets of its length, line lengths, mean word length and
repetition.  Term weights are damped counts times inverse document frequency;
a truncated SVD of the labelled sample's term matrix gives the latent space.
The labelled vectors, at most ``BOUND`` times ``RANK`` numbers, are broadcast;
every document's cosine with all of them is computed exactly, in blocks of
documents, and its ``NEIGHBOURS`` nearest vote with their similarity.

Defined results: null counts as empty; a vector without direction (and a run
without labelled rows) gets the share of label 1 among the sample (0.5 if
none); repeated rows are scored each; a null doc_id is not held out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.llm.common import read
from detflow.llm.labelled import fold, training_texts

BOUND = 8_192
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4               # a neighbour's vote is its cosine to this power
BLOCK = 256


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    for b in range(256):
        out[b] = (0 if 0x61 <= b <= 0x7A else 1 if 0x41 <= b <= 0x5A else 2 if 0x30 <= b <= 0x39 else 3 if b > 0x7F
                  else 4 if b == 0x20 else 5 if b == 0x0A else 7 + marks.index(b) if b in marks else 6)
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
BUCKETS = 16
N_TERMS = N_CLASSES * N_CLASSES + 5 * BUCKETS


def terms(text: str | None) -> np.ndarray:
    """Damped term counts of a whole text."""
    data = (text or "").encode()
    out = np.zeros(N_TERMS, np.float32)
    if not data:
        return out
    c = CLASS[np.frombuffer(data, np.uint8)]
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
        out[:N_CLASSES * N_CLASSES] = np.log1p(pairs * (1000.0 / len(c)))
    words = data.split()
    lines = data.split(b"\n")
    distinct = len(set(words)) / max(len(words), 1)
    measures = [np.log2(len(words) + 1), np.log2(len(data) / len(lines) + 1), 1.5 * len(data) / max(len(words), 1) - 1.5,
                15 * distinct, 15 * len(set(lines)) / len(lines)]
    for k, m in enumerate(measures):
        out[N_CLASSES * N_CLASSES + k * BUCKETS + int(min(max(m, 0), BUCKETS - 1))] = 2.0
    return out


@dataclass
class Model:
    weights: np.ndarray         # inverse document frequency
    axes: np.ndarray            # terms x rank
    vectors: np.ndarray         # labelled rows x rank, of length 1
    labels: np.ndarray
    share: float


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 3,
        held_out: int = 1, bound: int = BOUND) -> Model:
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([terms(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)], pa.binary()), batch.column(1)],
                ["terms", "label"])
    texts = training_texts(spark, docs, labels, label_col, modulus, held_out, bound)
    got = texts.mapInArrow(rows, "terms binary, label int").collect()      # at most `bound` rows
    if not got:
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0, np.float32), 0.5)
    got = sorted((bytes(r["terms"]), r["label"]) for r in got)
    x = np.stack([np.frombuffer(t, np.float16) for t, _ in got]).astype(np.float32)
    y = np.array([label for _, label in got], np.float32)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = unit(x * weights)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, np.argsort(values)[::-1][:RANK]].astype(np.float32)
    return Model(weights, axes, unit(x @ axes), y, float(y.mean()))


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a block of term rows."""
    if not len(model.vectors):
        return np.full(len(x), model.share)
    own = unit(unit(x * model.weights) @ model.axes)
    cosine = own @ model.vectors.T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, (weight * model.labels[near]).sum(1) / np.where(total > 0, total, 1), model.share)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(fit(spark, texts, labels))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                found = vote(np.stack([terms(t.as_py()) for t in block.column(1)]), shared.value)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])
    return texts.mapInArrow(rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
