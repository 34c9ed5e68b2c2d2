"""Toxicity by compression distance: how much better a window compresses with a dictionary of toxic text.

Two Zstandard dictionaries are trained, one on ordinary texts and one on what is distinctive of toxic texts (the
word beginnings that occur in them at many times their rate in ordinary texts). Every text is cut into windows of about
64 bytes at blanks; a window is compressed once with the ordinary dictionary and once with both, where filler of the
same size stands in for the toxic one, so that the lengths differ only by what toxic text explains. The gains of
a text's windows become log-likelihood ratios, and a logistic calibration makes a score between 0 and 1 of them.

Defined cases: a null or empty text is one empty window without gain and has a score too; without labels of both
classes every score is the share of toxic labels (0 without labels); rows that repeat keep a row each; columns other
than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.llm import textbytes as T
from skonto.llm.training import LONGEST, PER_CLASS, Logistic, Sample, fit_in_task, labelled_sample

WINDOW = 64
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 1_280
#: So many of the sample's ordinary texts at most, evenly picked, train the ordinary dictionary.
ORDINARY_TEXTS = 2000
#: A word beginning is distinctive in this share of toxic texts and at so many times its rate in ordinary texts.
SHARE, TIMES = 0.03, 20
SHORTEST, LONGEST_BEGINNING = 3, 12
GAINS = 10
THRESHOLD = 0.7


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin in a run of texts (one more entry than windows), and each text's first window."""
    n = np.diff(offsets)
    count = np.maximum(1, np.rint(n / size).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - first[text]
    edge = offsets[text] + k * n[text] // count[text]
    if len(data):
        blank = np.where(data == 32, np.arange(len(data)), len(data) + size)
        after = np.minimum.accumulate(blank[::-1])[::-1]
        to = after[np.minimum(edge, len(data) - 1)]
        edge = np.where((k > 0) & (to <= edge + size // 2) & (to < offsets[text + 1]), to, edge)
    return np.append(edge, offsets[-1]), first


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses windows against raw ``content``, without any header that isn't needed."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=15, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class Gains:
    """The two dictionaries; gives the gain of every window of a run of texts."""

    ordinary: bytes
    toxic: bytes

    def __post_init__(self) -> None:
        filler = np.random.default_rng(1).integers(0, 256, len(self.toxic)).astype(np.uint8).tobytes()
        self.contents = (self.ordinary + filler, self.ordinary + self.toxic)
        self._open: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gain of each window in bytes, and each text's first window."""
        self._open = self._open or tuple(map(compressor, self.contents))
        low = T.LOWER[data]
        edges, first = windows(low, offsets)
        gain = np.zeros(len(edges) - 1, np.int64)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            where = np.stack([edges[full], edges[full + 1] - edges[full]], axis=1).astype(np.uint64)
            held = zstandard.BufferWithSegments(low.tobytes(), where.tobytes())
            lengths = [np.fromiter(map(len, c.multi_compress_to_buffer(held, threads=0)), np.int64, len(full)) for c in self._open]
            gain[full] = lengths[0] - lengths[1]
        return gain, first


def _beginnings(w: T.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, words of n letters or more, hash of their first n letters); the whole word comes as n = 0."""
    up, down = T._tables()
    yield 0, np.arange(len(w.starts)), T.word_hashes(w)
    power = np.resize(up[: min(len(up), T.SEGMENT)], len(w.low))
    total = np.zeros(len(w.low) + 1, np.uint64)
    np.cumsum((w.low.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    for n in range(SHORTEST, LONGEST_BEGINNING + 1):
        k = np.flatnonzero((w.ends - w.starts >= n) & (w.starts % T.SEGMENT + n < T.SEGMENT))
        a = w.starts[k]
        yield n, k, T.mix((total[a + n] - total[a]) * down[a % T.SEGMENT] + np.uint64(n * int(T.STEP) % (1 << 64)))


def distinctive(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """For each toxic text its distinctive word beginnings, each after a blank and before one if it is the whole word."""

    def of(t: str) -> np.ndarray:
        w = T.words(*T.buffers(pa.array([t])))
        return np.unique(np.concatenate([h for _, _, h in _beginnings(w)]))

    def counted(texts: list[str], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """In how many texts each beginning occurs; a few hundred texts' beginnings are held at a time."""
        some, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for lo in range(0, len(texts), 250):
            seen = np.concatenate([of(t) for t in texts[lo : lo + 250]])
            more, m = np.unique(seen if among is None else seen[np.isin(seen, among)], return_counts=True)
            some, where = np.unique(np.concatenate([some, more]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, m])).astype(np.int64)
        return some, n

    here, n = counted(toxic)
    often = n >= max(3, SHARE * len(toxic))
    here, n = here[often], n[often]
    there = dict(zip(*(x.tolist() for x in counted(ordinary, here))))
    other = np.array([there.get(h, 0) for h in here.tolist()])
    good = here[n / max(len(toxic), 1) >= TIMES * (other + 1) / (len(ordinary) + 1)]
    out = []
    for t in toxic:
        w = T.words(*T.buffers(pa.array([t])))
        raw, best = w.low.tobytes(), {}
        for n, k, h in _beginnings(w):
            for i in k[np.isin(h, good)].tolist():
                best[i] = max(best.get(i, 0), n or int(w.ends[i] - w.starts[i]))
        out.append(b"".join(b" " + raw[w.starts[i] : w.starts[i] + n] + b" " * int(w.starts[i] + n == w.ends[i]) for i, n in sorted(best.items())))
    return [x for x in out if x]


def dictionary(samples: list[bytes], size: int, segment: int, d: int) -> bytes:
    """A dictionary trained on ``samples``; too few of them are the dictionary themselves."""
    if not any(samples):
        return b""
    many = samples * max(1, -(-size * 20 // max(1, sum(map(len, samples)))), -(-64 // len(samples)))
    try:
        return zstandard.train_dictionary(size, many, k=segment, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    """Scores runs of texts."""

    gains: Gains
    ratio: np.ndarray
    calibration: Logistic | None
    base: float

    def columns(self, gain: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the calibration sees of each text."""
        at, n = first[:-1], np.diff(first)
        ratio = self.ratio[np.clip(gain, -2, GAINS - 3) + 2]
        text = np.repeat(np.arange(len(n)), n)
        top = gain[np.lexsort((gain, text))]
        second = np.where(n > 1, top[np.maximum(first[1:] - 2, 0)], 0)
        total = np.add.reduceat(ratio, at)
        return np.c_[total, np.log(n), top[first[1:] - 1], second, np.add.reduceat(np.maximum(gain - 1, 0), at) / np.sqrt(n), total / n]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score for each text of a run."""
        if self.calibration is None:
            return np.full(len(offsets) - 1, self.base)
        return self.calibration(self.columns(*self.gains(data, offsets)))


def fit(sample: Sample) -> ToxicityModel:
    """Dictionaries from three quarters of the sample, ratios and calibration from the rest."""
    base = sample.total[1] / sum(sample.total) if sum(sample.total) else 0.0
    learn, rest = np.flatnonzero(sample.order % 4 != 3), np.flatnonzero(sample.order % 4 == 3)
    if len(sample.y) == 0 or any(len(set(sample.y[part].tolist())) < 2 for part in (learn, rest)):
        return ToxicityModel(Gains(b"", b""), np.zeros(GAINS), None, base)
    texts = [sample.texts[int(i)].as_py() for i in learn]
    ordinary = [t for t, y in zip(texts, sample.y[learn]) if not y]
    toxic = [t for t, y in zip(texts, sample.y[learn]) if y]
    pieces = []
    for _, _, data, offsets in T.chunks(pa.array(ordinary[:: -(-len(ordinary) // ORDINARY_TEXTS)])):
        low = T.LOWER[data]
        edges, _ = windows(low, offsets, 2 * WINDOW)
        raw = low.tobytes()
        pieces += [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b > a]
    gains = Gains(dictionary(pieces, ORDINARY_BYTES, 64, 8), dictionary(distinctive(toxic, ordinary), TOXIC_BYTES, 24, 6))
    model = ToxicityModel(gains, np.zeros(GAINS), None, base)
    parts = [gains(data, offsets) for _, _, data, offsets in T.chunks(sample.texts.take(pa.array(rest)))]
    gain = np.concatenate([g for g, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    y, weight = sample.y[rest], sample.weights()[rest]
    toxic_window = np.repeat(y, np.diff(first)) == 1
    often = [np.bincount(np.clip(gain[x], -2, GAINS - 3) + 2, minlength=GAINS) + 0.5 for x in (~toxic_window, toxic_window)]
    model.ratio = np.maximum.accumulate(np.log(often[1] / often[1].sum()) - np.log(often[0] / often[0].sum()))
    model.calibration = Logistic.fit(model.columns(gain, first), y, weight)
    return model


def train(documents: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> ToxicityModel:
    """A model from a bounded sample of labelled documents, see ``labelled_sample``."""
    return fit_in_task(*labelled_sample(documents, labels, label, usable, doc_id, text, per_class, longest), fit)


def scored(documents: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the score of each whole text in a column of that name."""
    names = [c for c in documents.columns if c != score]
    schema = documents.select(*[F.col(f"`{c}`") for c in names]).withColumn(score, F.lit(0.0)).schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(data, offsets) for _, _, data, offsets in T.chunks(batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*names, score])

    return documents.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


