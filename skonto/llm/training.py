"""Bounded samples of labelled documents, models fitted in a task, and the logistic calibration that the classifiers share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that a model learns from: most texts of each class, and the longest text in bytes.
PER_CLASS = 4000
LONGEST = 16_384


@dataclass
class Sample:
    """Texts with their 0/1 label; ``total`` counts all labelled rows of class 0 and 1."""

    texts: pa.Array
    y: np.ndarray
    order: np.ndarray
    total: tuple[int, int]

    def weights(self) -> np.ndarray:
        """Weights that give the classes of the sample the shares that they have among all labelled rows."""
        have = np.bincount(self.y, minlength=2)
        return np.where(self.y == 1, self.total[1] / max(have[1], 1), self.total[0] / max(have[0], 1)) * len(self.y) / max(sum(self.total), 1)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, usable: Column, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, longest: int = LONGEST
) -> tuple[DataFrame, tuple[int, int]]:
    """(id, text, y) of up to about ``per_class`` usable labelled texts of each class, chosen by a hash of their id, and how
    many labelled rows of class 0 and 1 there are.

    A row is usable if ``usable``, a condition on the column ``id``, holds. Rows without id or label, and texts longer
    than ``longest`` bytes, teach nothing; of several labels of an id the largest counts, of several texts the smallest.
    """
    known = (
        labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & usable)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, per_class / max(total.get(1, 0), 1)).otherwise(per_class / max(total.get(0, 0), 1))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(draw < share)
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(
        F.octet_length("text") <= longest
    )
    # at most a few thousand ids, so they go to every task and the documents stay where they are
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows, (total.get(0, 0), total.get(1, 0))


def fit_in_task(rows: DataFrame, total: tuple[int, int], fit: Callable[[Sample], Any]) -> Any:
    """What ``fit`` makes of the bounded sample ``rows``. One task fits; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("text", pa.string()), ("y", pa.int32())]))
        ids = held["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        held = held.take(pa.array(order))
        spread = np.array([(int(i) * 0x9E3779B97F4A7C15 >> 32) % 1000 for i in ids[order]], np.int64)
        sample = Sample(held["text"].combine_chunks(), held["y"].to_numpy().astype(np.int64), spread, total)
        yield pa.record_batch([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])

    fitted = rows.select("id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    if fitted is None:  # Spark runs no task on what it knows to be empty
        return fit(Sample(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), total))
    return pickle.loads(fitted.model)


@dataclass
class Logistic:
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 0.1) -> Logistic:
        """Newton steps on the weighted, ridge-penalised likelihood."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (sample_weight * (p - y)) + ridge * w
            w = w - np.linalg.solve((z * (sample_weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * ridge, slope)
        return cls(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weight, -30, 30)))
