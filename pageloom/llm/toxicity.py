"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.features import code_points, grams
from pageloom.llm.shared import released

SIZES, BITS = (4, 5, 6), 18
#: The model learns from about so many labelled rows of each class, chosen by a hash of the id, as far as they have
#: no more than so many different n-grams together.
TRAIN_ROWS, TRAIN_GRAMS = 1500, 12_000_000
#: Texts that each bucket is thought to be in besides those seen, dealt to the classes by their sizes: the log ratio of a
#: rare bucket is near 0.
PRIOR = 30.0
#: Values are SCALE * r * |r| over the root of the number of buckets. Toxic texts' part of the loss, the penalty on
#: weights, steps and their size.
SCALE, SHARE, L2, ROUNDS, RATE = 10.0, 0.57, 1e-3, 40, 0.03


@dataclass(frozen=True)
class Model:
    """weight: the learned weight times the scaled log ratio of each bucket."""

    weight: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        z = self.bias + float(self.weight[buckets].sum(dtype=np.float64)) / max(1.0, len(buckets)) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Presence:
    """The different buckets of one text after another, with one reused table of flags."""

    def __init__(self, bits: int = BITS):
        self._flag, self._bits = np.zeros(1 << bits, bool), bits

    def __call__(self, text: str | None) -> np.ndarray:
        points = code_points(text or "")
        for g in grams(points, SIZES, self._bits):
            self._flag[g] = True
        found = np.flatnonzero(self._flag)
        self._flag[found] = False
        return found.astype(np.uint32)


def training_rows(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int = TRAIN_ROWS) -> DataFrame:
    """(text, y): rows whose id has exactly one label value 0 or 1, about per_class of each, by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").drop("y2")
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = one.where(u < share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")


def log_ratios(docs: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """The log ratio of how often the classes have each bucket."""
    seen = np.zeros((2, size))
    for f, label in zip(docs, y.astype(int).tolist(), strict=True):
        seen[label, f] += 1
    n = np.array([len(y) - y.sum(), y.sum()])
    rate = (seen + PRIOR * n[:, None] / n.sum()) / (n * (1 + PRIOR / n.sum()))[:, None]
    return np.log(rate[1] / rate[0])


def learned(docs: list[np.ndarray], labels: list[int]) -> Model:
    """Logistic regression on the presence of every bucket, scaled by the log ratios; without both classes, the known one."""
    size, y = 1 << BITS, np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), 30.0 if labels and labels[0] else -30.0)
    r = log_ratios(docs, y, size)
    scaled = (SCALE * r * np.abs(r)).astype(np.float32)
    n1 = y.sum()
    weigh = np.where(y == 1, SHARE / n1, (1 - SHARE) / (len(y) - n1))
    # the rows' entries, and the same entries by bucket
    width = np.array([len(f) for f in docs])
    filled = np.flatnonzero(width)
    begin = (np.cumsum(width) - width)[filled]
    col, root = np.concatenate(docs), (1 / np.sqrt(np.maximum(width, 1))).astype(np.float32)
    order = np.argsort(col, kind="stable").astype(np.int32)
    by_col = np.repeat(np.arange(len(docs), dtype=np.int32), width)[order]
    used, at = np.unique(col[order], return_index=True)
    del order
    w, b = np.zeros(size, np.float32), 0.0
    m, v, mb, vb = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = np.full(len(docs), b)
        if len(col):
            z[filled] += np.add.reduceat((scaled * w)[col], begin) * root[filled]
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weigh
        g = L2 * w
        if len(col):
            g[used] += scaled[used] * np.add.reduceat((err * root).astype(np.float32)[by_col], at)
        gb = float(err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model((w * scaled).astype(np.float32), b)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, u, f): each text's buckets, and a hash of them that puts the rows in one order."""
    present = Presence()
    for batch in batches:
        found = [present(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array([crc32(f) for f in found], pa.int64()), pa.array(found, pa.binary())], ["y", "u", "f"])


def fit(rows: DataFrame, limit: int = 2 * TRAIN_ROWS + 1000, grams: int = TRAIN_GRAMS) -> Model:
    """The model of the bounded sample `rows`, learned in one task; only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        y: list[int] = []
        left = grams
        for batch in batches:
            for label, f in zip(batch.column("y").to_pylist(), batch.column("f"), strict=True):
                buckets = np.frombuffer(f.as_py(), np.uint32)
                left -= len(buckets)
                if left >= 0:
                    docs.append(buckets)
                    y.append(label)
        model = learned(docs, y)
        del docs
        released()
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([float(model.bias)])], ["weight", "bias"])

    sample = rows.mapInArrow(_sampled, "y int, u long, f binary").limit(limit).repartition(1).sortWithinPartitions("u", "y", "f")  # the same model whatever the order of arrival
    got = sample.mapInArrow(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(got[0]["weight"], "<f4"), got[0]["bias"]) if got else learned([], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Presence()
        for batch in batches:
            scores = [shared.value.score(present(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn: F.Column) -> DataFrame:
    """(doc_id, score, predicted) of every document, by a model of the labelled documents that `learn` admits.

    Repeated ids with contradicting labels teach nothing; without both classes the known class is predicted;
    an empty table gives an empty result; other columns of either table are ignored.
    """
    scored = score(docs, fit(training_rows(docs, labels, learn)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
