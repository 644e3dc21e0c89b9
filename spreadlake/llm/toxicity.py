"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: single words, neighbouring pairs, and pairs with
one word between, hashed to ``DIMS`` places.  FTRL-proximal learns them one
document after another with a rate per coordinate; its L1 term leaves few
weights other than zero, which go to the executors as two short arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import ALNUM, text_bytes, words_of

BITS = 20
DIMS = 1 << BITS
#: Most labelled documents the fit sees (bound of the sample).
TRAIN_DOCS = 8000
EPOCHS = 6
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - BITS)


def features(text: bytes) -> np.ndarray:
    """Places of all words, pairs and skip-pairs of a whole text (with repeats); none for an empty text."""
    words = words_of(text, ALNUM)
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    parts = [h * _A, h[:-1] * _B ^ (h[1:] * _C), h[:-2] * _C ^ (h[2:] * _A)]
    return (np.concatenate([p * _A for p in parts]) >> _SHIFT).astype(np.int64)


@dataclass
class Model:
    """Intercept and the weights that are not zero."""

    bias: float
    places: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(DIMS, np.float32)
        out[self.places] = self.weights
        return out


class Ftrl:
    """Per-coordinate FTRL-proximal state for a logistic loss."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)  # the last place is the intercept

    def weight(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == DIMS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, DIMS)
        w = self.weight(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g

    def model(self) -> Model:
        w = self.weight(np.arange(DIMS + 1))
        places = np.flatnonzero(w[:DIMS])
        return Model(float(w[DIMS]), places.astype(np.int32), w[places].astype(np.float32))


def in_training_fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS, epochs: int = EPOCHS) -> Model:
    """Fit on at most about ``most`` labelled documents of the training fold, chosen by the hash of their id.

    Null labels and null ids are left out; repeated rows count each time.
    Without any usable label the model scores 0.5 everywhere.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & in_training_fold(id_col)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    total = usable.count()
    share = 1_000_000 if total <= most else max(1, most * 1_000_000 // total)
    chosen = usable.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share)
    # about ``most`` rows of two numbers: small whatever the tables' size
    rows = docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("raw")).join(F.broadcast(chosen), "key")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "places": [np.unique(features(t)).astype("<i4").tobytes() for t in pdf["raw"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.mapInPandas(look, f"key {kind}, label int, places binary").toPandas().sort_values(["key", "label", "places"], kind="stable")
    ftrl, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(sample)):
            ftrl.learn(np.frombuffer(sample["places"].iloc[i], "<i4").astype(np.int64), int(sample["label"].iloc[i]))
    return ftrl.model()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``score`` (0 to 1) of every row; a null or empty text scores by the intercept alone.

    Null ids and repeated rows are scored like others.  Only the text enters the score.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.table()
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, text in enumerate(pdf["raw"]):
                places = features(text)
                hit = np.unique(places[weights[places] != 0])
                out[i] = model.bias + weights[hit].sum(dtype=np.float64)
            yield pd.DataFrame({"key": pdf["key"], "score": 1 / (1 + np.exp(-np.clip(out, -500, 500)))})

    picked = docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("raw"))
    return picked.mapInPandas(run, f"key {kind}, score double").withColumnRenamed("key", id_col)
