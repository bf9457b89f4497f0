"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one or two words between, hashed into
2**BITS places. Each place has its own learning rate; the L1 term leaves most weights at zero, so that the model is a short
list of (place, weight), broadcast as a sparse table of at most 2**BITS rows.

The model is fitted on at most TRAIN_ROWS labelled documents, those with the smallest hash of their identifier; everything
else reads every row. One task fits; it holds four bytes for each different feature of those documents, of which a very long text has
2**BITS at most. Null labels are left out; an identifier with several labels has the largest, one with several texts the least.
Where no row is labelled, every score is the neutral prior; where all labels are equal, every score leans to that label. Null and empty
texts score by the intercept alone. Rows that repeat score alike; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

BITS = 20
#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 15_000
_TRIM = re.compile(r"[^\W_]+")
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


class Hashed:
    """Places of the features of texts; words are lower-cased and freed of punctuation."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint32(32 - bits), {}

    def word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[w] = zlib.crc32("".join(_TRIM.findall(w.lower())).encode("utf-8", "replace"))
        return h

    def places(self, text: str) -> np.ndarray:
        """A place for each occurrence of each feature."""
        ws = text.split()
        try:
            h = np.fromiter(map(self.known.__getitem__, ws), np.uint32, len(ws))
        except KeyError:
            h = np.fromiter(map(self.word, ws), np.uint32, len(ws))
        parts = [h * _MIX[0]]
        for gap in (1, 2, 3):
            pair = h[:-gap] * _MIX[1] ^ (h[gap:] * _MIX[2] + np.uint32(gap))
            parts.append((pair ^ pair >> np.uint32(15)) * _MIX[0])
        return np.concatenate(parts) >> self.shift


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 6) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, places and weights. Rows are distinct places; each pass takes them in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            w0 = -z0 / ((beta + math.sqrt(n0)) / alpha)
            g = _sigmoid(w0 + float(w.sum())) - y
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / alpha * w0
            n0 += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    return -z0 / ((beta + math.sqrt(n0)) / alpha), at, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """place, weight; the intercept at place -1. labels must hold training rows only."""
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(rows)  # at most rows rows: their broadcast is bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashed()
        for b in batches:
            at = [np.unique(own.places(t or "")).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.binary())], names=["id", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(zlib.crc32(str(i).encode()), i, a, y) for b in batches for i, y, a in zip(*(b.column(k).to_pylist() for k in range(3)))]
        got.sort(key=lambda x: x[:2])
        w0, at, w = fit([np.frombuffer(x[2], "<u4") for x in got], [x[3] for x in got]) if got else (0.0, np.zeros(0, int), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, w0), pa.float64())], names=["place", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = written(texts.mapInArrow(features, f"id {kind}, y int, at binary"), "toxicity-sample")  # so that all tasks look for it, and one only fits
    return sample.coalesce(1).mapInArrow(learn, "place long, weight double")


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score; model as train() gives it."""
    got = model.toPandas()  # sparse weights, 2**BITS + 1 rows at most
    weights = np.zeros(1 << BITS, np.float32)
    own = got[got["place"] >= 0]
    weights[own["place"].to_numpy(np.int64)] = own["weight"]
    w0 = float(got.loc[got["place"] < 0, "weight"].sum())
    sparse = docs.sparkSession.sparkContext.broadcast((own["place"].to_numpy(np.uint32), own["weight"].to_numpy(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, dense = Hashed(), np.zeros(1 << BITS, np.float32)
        dense[sparse.value[0]] = sparse.value[1]
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                at = hashed.places(t or "")
                at = np.unique(at[dense[at] != 0])
                out.append(_sigmoid(w0 + float(dense[at].sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = in_fold(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held).select("doc_id", "toxic")
    model = written(train(docs, labels, "toxic"), "toxicity-model")
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
