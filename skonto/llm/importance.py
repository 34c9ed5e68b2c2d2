"""Importance resampling towards a target: hashed n-grams counted by sorting, weights gathered from packed streams.

Each text becomes a stream of uint16 buckets, one for each run of 1 to ``longest`` words, written to the shared folder packed one
text after another with the offsets of the texts. Counts of all buckets come from the streams alone: each is sorted, its runs
are run-length encoded, and a task's runs are summed before the shuffle. A bucket's gain says how much likelier it is in
the target; a second reading of the streams gathers the gains and sums them text by text with ``np.add.reduceat``. Scores get
Gumbel noise from a hash of the id, so the highest scores are a draw without replacement by weight. Ranks are positions in
a distributed sort. Only the counts of the buckets come to the driver.

Defined cases: a null text has no words; a text without words has weight 0; rows without an id draw the noise of an empty
id and rank after rows with one if scores are equal; of rows that repeat an id and a score any comes first; an empty table
gives no rows, an empty target makes all gains those of counts of nothing; a text of any length is cut into runs of
bounded size; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm import textbytes as T
from skonto.llm.common import materialise

BUCKETS, LONGEST_RUN, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text that one packed stream holds, but for its last text.
STREAM_BYTES = 1 << 20
ROW = "_row"
#: Words up to so many bytes are appended to a checksum by one look into a table.
TABLED = 64
BLANK = np.uint32(zlib.crc32(b" "))


def appended_tables(longest: int = TABLED) -> np.ndarray:
    """[n, k, v]: what ``v`` in byte ``k`` of a CRC-32 becomes when ``n`` bytes of zero follow."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = byte << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


_TABLES: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after another, from theirs and the ``size`` of the second."""
    if not _TABLES:
        _TABLES.append(appended_tables())
    tables = _TABLES[0]

    def zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = tables[n, 0, crc & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ tables[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    moved, left = first, size
    while len(left) and (longest := int(left.max())) > TABLED:
        at = np.flatnonzero(left > TABLED)
        moved, left = moved.copy(), left.copy()
        if longest > 64 * TABLED and len(at) == 1:  # a single giant word
            crc, n = moved[at], (longest - 1) // TABLED
            for _ in range(n):
                crc = zeros(crc, np.array([TABLED]))
            moved[at], left[at] = crc, longest - n * TABLED
        else:
            moved[at], left[at] = zeros(moved[at], np.full(len(at), TABLED)), left[at] - TABLED
    return zeros(moved, left) ^ second


def word_crcs(w: T.Words) -> np.ndarray:
    """CRC-32 of each word; equal words of the run are looked up once."""
    found = T.distinct(w)
    crcs = np.fromiter(map(zlib.crc32, found.dictionary.to_pylist()), np.uint32, len(found.dictionary))
    return crcs[found.indices.to_numpy()]


def run_buckets(w: T.Words, again: int, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of words, text after text, and how many each text has; runs within the first ``again`` words are not repeated."""
    n, size, crc = len(w.starts), w.ends - w.starts, word_crcs(w)
    begins = np.repeat(w.rows[:-1], np.diff(w.rows))
    found, valid = np.zeros((n, longest), np.uint16), np.zeros((n, longest), bool)
    so_far = crc
    for k in range(longest):  # runs of k + 1 words that end at each word
        if k:
            longer = np.zeros(n, np.uint32)
            blank = joined_crc(so_far[:-1], np.full(max(n - 1, 0), BLANK), np.ones(max(n - 1, 0), np.int64))
            longer[1:] = joined_crc(blank, crc[1:], size[1:])
            so_far = longer
        found[:, k] = so_far % np.uint32(buckets)
        valid[:, k] = (np.arange(n) - k >= begins) & (np.arange(n) >= again)
    each = np.concatenate([[0], np.cumsum(valid.sum(1))])
    return found[valid], each[w.rows[1:]] - each[w.rows[:-1]]


STREAM = "rows array<long>, words array<long>, sizes array<long>, stream binary"


def _streams(buckets: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for lo, hi, w, _, again in T.word_runs(batch.column(1), STREAM_BYTES, longest - 1):
                stream, sizes = run_buckets(w, again, buckets, longest)
                words = np.diff(w.rows)
                words[0] -= again
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (rows[lo:hi], words, sizes)]
                yield pa.record_batch([*lists, pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=["rows", "words", "sizes", "stream"])

    return run


def bucket_streams(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Packed streams of (row number, text), written to the shared folder; a long text goes over several."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has to fit into 16 bits")
    return materialise(rows.mapInArrow(_streams(buckets, longest), STREAM), "bucket-streams")


def _runs(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                stream = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")
                first = np.flatnonzero(np.diff(stream, prepend=stream[:1] ^ 1))
                total[stream[first]] += np.diff(first, append=len(stream))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is in the streams; one number a bucket comes to the driver."""
    found = streams.select("stream").mapInArrow(_runs(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log of each bucket's smoothed share of the target over that of the corpus, rounded down."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _gathered(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows, words, sizes = (batch.column(c)[k].values for c in range(3))
                n = sizes.to_numpy()
                total, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
                if len(some):
                    offsets = np.cumsum(n) - n
                    total[some] = np.add.reduceat(gain[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")], offsets[some])
                yield pa.record_batch([rows, words, sizes, pa.array(total)], names=[ROW, "words", "n_features", "total"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def in_order(rows: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``keys``, which tell all rows apart.

    The sort is by ranges. A row's place is that in its range plus the rows of the ranges before, of which there are as many as
    the sort has tasks.
    """
    placed = materialise(rows.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    split = placed.withColumn("_range", F.shiftright("_at", 33))
    ranges = split.groupBy("_range").agg(F.count("*").alias("k"))
    before = ranges.select("_range", (F.sum("k").over(Window.orderBy("_range")) - F.col("k")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return split.join(F.broadcast(before), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def resampled(
    documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED, number: str | None = None,
) -> DataFrame:
    """One row per document row: ``_row`` (its number), doc_id, words, n_features, weight, score, rank (null if it is not drawn).

    ``number`` may name a column of different longs; otherwise rows are numbered as they are read.
    """
    number = F.col(number) if number else F.monotonically_increasing_id()
    numbered = documents.select(number.alias(ROW), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    streams = bucket_streams(numbered.select(ROW, "text"), buckets, longest)
    wanted = bucket_streams(target.select(F.lit(0).cast("long").alias(ROW), F.col(target_text).cast("string").alias("text")), buckets, longest)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    pieces = streams.mapInArrow(_gathered(gain), f"{ROW} long, words long, n_features long, total long")
    whole = pieces.groupBy(ROW).agg(*[F.sum(c).alias(c) for c in ("words", "n_features", "total")])
    # weights are rounded down, below 0 too
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    scored = materialise(
        whole.join(numbered.select(ROW, "doc_id"), ROW).select(ROW, "doc_id", "words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score")),
        "importance-scores",
    )
    able = scored.where(F.col("words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = in_order(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(ROW))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The documents that are drawn, with all their columns and their ``rank``."""
    name = next(x for x in (f"{ROW}{'_' * k}" for k in range(len(documents.columns) + 1)) if x not in documents.columns)
    numbered = materialise(documents.withColumn(name, F.monotonically_increasing_id()), "numbered-documents")
    ranks = resampled(numbered, target, doc_id, text, number=name, **options).where("rank is not null").select(F.col(ROW).alias(name), "rank")
    return numbered.drop("rank").join(ranks, name).drop(name)
