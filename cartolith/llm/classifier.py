"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Tokens are words and runs of punctuation, case kept; features are hashed one-
and two-token sequences and two shapes of repetition.  A text is a sparse
vector of square roots of relative frequencies, of length one, so its score is
a sparse dot product.

Training takes at most ``MAX_TRAIN`` labelled rows, those with the smallest
hashes of their identifiers: a bounded sample of labelled rows, chosen without
regard to the order of files.  Everything is scored, whole.

Defined cases: a null text is empty and gets the score of the bias; identifiers
that are null are scored, not held out, and never trained on; where rows of
labels repeat an identifier its lowest quality counts, and where rows of
documents do, the least of their texts is learnt from, so the bound is one of
rows; without any label the score is 0.5; repeated rows are scored each, texts
of any length whole; an empty table gives no row; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import batches as byte_batches
from .textbytes import splitmix, word_hashes

DIMS, MAX_TRAIN, UPDATES = 1 << 18, 8192, 40_000
_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")
_U = np.uint64


def features(texts: list[bytes], dims: int = DIMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text."""
    words, counts = word_hashes([_PUNCTUATION.sub(rb" \g<0> ", t) for t in texts], lower=False)
    out, at = [], 0
    with np.errstate(over="ignore"):
        pairs = splitmix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
        mask = _U(dims - 1)
        one = (splitmix(words + _U(1)) & mask).astype(np.int64)
        two = (pairs & mask).astype(np.int64)
    for c in counts.tolist():
        w = words[at : at + c]
        again = [np.full(int((w[k:] == w[:-k]).sum()), k, np.int64) for k in (1, 2, 3) if c > k]
        idx, tf = np.unique(np.concatenate([one[at : at + c], two[at : at + max(c - 1, 0)], *again]), return_counts=True)
        value = np.sqrt(tf)
        out.append((idx, value / np.sqrt(max((value**2).sum(), 1.0))))
        at += c
    return out


class FTRL:
    """Follow-the-regularised-leader for logistic loss, per-coordinate rates."""

    def __init__(self, dims: int = DIMS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, idx: np.ndarray, value: np.ndarray, label: float) -> None:
        idx, value = np.r_[idx, len(self.z) - 1], np.r_[value, 1.0]  # the last weight is the bias
        w = self.weights(idx)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def train(rows: list[tuple[bytes, int]], updates: int = UPDATES) -> np.ndarray:
    """Passes over the rows in their order, about ``updates`` steps in 3 to 30 passes."""
    epochs = min(30, max(3, updates // max(1, len(rows))))
    model = FTRL()
    made = []
    for a, b in byte_batches([t for t, _ in rows]):
        made += features([t for t, _ in rows[a:b]])
    for _ in range(epochs):
        for (idx, value), (_, label) in zip(made, rows):
            model.learn(idx, value, label)
    return model.weights()


def is_held_out(key: str = "doc_id"):
    """crc32 of the identifier as text, modulo 5, is 0; false for a null identifier."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(text, label), at most ``most`` rows, none of them held out."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("label"))
    picked = known.filter(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a top-k, its size is the bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> np.ndarray:
    """The weights; one task trains on the bounded sample, and only weights reach the driver."""

    def run(batches):
        rows = []
        for batch in batches:
            rows += [(i, t.encode("utf-8", "surrogatepass"), y) for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")))]
        rows.sort(key=lambda r: (splitmix(np.array([r[0] & (2**63 - 1)], _U))[0], r[0], r[1]))
        w = train([(t, y) for _, t, y in rows]) if rows else np.zeros(DIMS + 1)
        idx = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([idx.astype("<i4").tobytes()], pa.binary()), pa.array([w[idx].astype("<f8").tobytes()], pa.binary())], names=["idx", "value"])

    # All tasks scan; only the bounded sample is shuffled to the one that trains.
    got = training_rows(docs, labels, most).repartition(1).mapInArrow(run, "idx binary, value binary").collect()
    w = np.zeros(DIMS + 1)
    for r in got:
        w[np.frombuffer(r["idx"], "<i4")] = np.frombuffer(r["value"], "<f8")
    return w


SCHEMA = "doc_id long, score double"


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = spark.sparkContext.broadcast(weights)  # DIMS + 1 numbers, whatever the corpus

    def run(batches):
        w = shared.value
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            dots = []
            for a, b in byte_batches(texts):
                dots += [w[idx] @ value + w[-1] for idx, value in features(texts[a:b])]
            scores = 1 / (1 + np.exp(-np.clip(np.array(dots, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
