"""Text quality by a generalised additive model with pairwise interactions.

Each text gives a few shape features (shares of characters, repetition, lengths). A feature is cut into bins at
its quantiles; small trees are boosted on one feature after another, round and round, so each feature's trees add up to
a table of one value a bin; then trees of two features are boosted for the pairs that explain most of what is left. A
score is the logistic of the intercept plus one table value for each feature and pair: additions over bins, nothing else.

Defined cases: a null or empty text has features of its own (all zero) and a score like any other; without labels
of both classes every score is the share of label 1 (0 without labels); rows that repeat keep a row each; columns other
than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.llm import textbytes as T
from skonto.llm.training import LONGEST, PER_CLASS, Sample, fit_in_task, labelled_sample

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 120, 60, 0.15, 5.0
THRESHOLD = 0.7

FEATURES = ("log_bytes", "log_words", "upper", "digit", "common_mark", "rare_mark", "bang", "bar", "blank", "line", "word_length", "distinct", "repeat", "top_word")

_UPPER, _DIGIT, _COMMON, _RARE, _BANG, _BAR, _BLANK, _LINE = range(8)
_CLASS = np.full(256, 8, np.uint8)
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = _RARE
for _marks, _kind in ((b".,;:'\"?-()", _COMMON), (b"!", _BANG), (b"|", _BAR), (b" \t", _BLANK), (b"\n\r", _LINE)):
    _CLASS[list(_marks)] = _kind
_CLASS[65:91], _CLASS[48:58] = _UPPER, _DIGIT


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text of a run, with the columns ``FEATURES``."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    kinds = np.bincount(rows * 9 + _CLASS[data], minlength=9 * len(n)).reshape(-1, 9)[:, :8] / np.maximum(n, 1)[:, None]
    w = T.words(data, offsets)
    h = T.word_hashes(w)
    words = np.diff(w.rows)
    some = np.maximum(words, 1)
    letters = np.bincount(np.repeat(np.arange(len(n)), words), weights=w.ends - w.starts, minlength=len(n))
    owner = np.repeat(np.arange(len(n)), words)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    sorted_h, sorted_owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    begin = np.flatnonzero(new)
    top = np.zeros(len(n))
    np.maximum.at(top, sorted_owner[begin], np.diff(np.append(begin, len(h))))
    different = np.bincount(sorted_owner[begin], minlength=len(n))
    return np.c_[
        np.log1p(n), np.log1p(words), kinds, letters / some, different / some**0.9, np.bincount(owner, weights=again, minlength=len(n)) / some, top / some
    ]


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + SMOOTH) + (all_g - left_g) ** 2 / (all_h - left_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of up to ``leaves`` leaves on one feature: its step for every bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda x: x[0])
        gain, at, a, b = best
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better tree of depth two on two features: its gain and its step for every pair of bins."""

    def cut(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        first, at = _split(g.sum(1), h.sum(1))
        out, gain = np.zeros_like(g), first
        for side in (slice(0, at), slice(at, None)):
            part_g, part_h = g[side].sum(0), h[side].sum(0)
            more, at2 = _split(part_g, part_h)
            gain += more
            for other in (slice(0, at2), slice(at2, None)):
                out[side, other] = part_g[other].sum() / (part_h[other].sum() + SMOOTH)
        return gain, out

    one, (gain, other) = cut(g, h), cut(g.T, h.T)
    return one if one[0] >= gain else (gain, other.T)


@dataclass
class QualityModel:
    """Bin edges, tables and the logistic of their sum."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        """Each feature's bin."""
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def pair_bins(self, x: np.ndarray) -> list[np.ndarray]:
        """Each feature's coarser bin, for pairs."""
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        total = np.full(len(x), self.intercept)
        for b, table in zip(self.bins(x), self.tables):
            total += table[b]
        coarse = self.pair_bins(x) if self.pairs else []
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Boost single features in turn, then pairs, on weighted rows."""
    rate = float(np.average(y, weights=weight))
    model = QualityModel(float(np.log(rate / (1 - rate))))
    cuts = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
    # quantiles of each class, so that a feature that only few rows have is still cut
    model.edges = [np.unique(np.concatenate([cuts(x[y == v, k], BINS // 2) for v in (0, 1)])) for k in range(x.shape[1])]
    model.pair_edges = [np.unique(np.concatenate([cuts(x[y == v, k], PAIR_BINS // 2) for v in (0, 1)])) for k in range(x.shape[1])]
    bins, coarse = model.bins(x), model.pair_bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * line_tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[k] += step
            total += step[b]

    def plane(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((plane_tree(*plane(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * plane_tree(*plane(i, j))[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def fit_sample(sample: Sample) -> QualityModel:
    """A model of a sample; of one with a single class, or none, only its share of label 1."""
    if len(set(sample.y.tolist())) < 2:
        share = sample.total[1] / sum(sample.total) if sum(sample.total) else 0.0
        return QualityModel(float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)))
    x = np.concatenate([features(data, offsets) for _, _, data, offsets in T.chunks(sample.texts)])
    return fit(x, sample.y, sample.weights())


def train(documents: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST) -> QualityModel:
    """A model from a bounded sample of labelled documents, see ``labelled_sample``."""
    return fit_in_task(*labelled_sample(documents, labels, label, usable, doc_id, text, per_class, longest), fit_sample)


def scored(documents: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the score of each whole text in a column of that name."""
    names = [c for c in documents.columns if c != score]
    kept = documents.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, offsets)) for _, _, data, offsets in T.chunks(batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*names, score])

    return kept.mapInArrow(run, kept.withColumn(score, F.lit(0.0)).schema)
