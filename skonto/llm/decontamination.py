"""Benchmark decontamination as a prefix-filtered set join of document words with benchmark windows.

A benchmark item is cut into windows of 13 words (an item of fewer words is one window). A window can only
occur in a document that holds all its shingles, so it is enough to look for one of them, its *necessary
prefix*: the one that is rarest in the documents. Documents give up only the shingles that are some
window's prefix; the join with the windows applies the positional and length bounds (the window must lie
inside the document) and compares the words themselves, so hash collisions change nothing.

Defined cases: a null or wordless text has no words and is never hit; a null or wordless item has no window;
items without an id count in ``n_hit`` but not in ``n_items``; rows that repeat a document are judged alike
and each keeps its row; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto.llm import textbytes as T
from skonto.llm.common import materialise

WINDOW = 13
SHINGLE = 5
#: So many window shingles (8 bytes each) may be sent to every task; beyond it the blocks are a series of passes.
BROADCAST_TOKENS = 4_000_000


def _windows(window: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in T.chunks(batch.column(1)):
                w = T.words(data, offsets)
                h = T.word_hashes(w)
                out = []
                for r in range(hi - lo):
                    a, b = int(w.rows[r]), int(w.rows[r + 1])
                    if a == b:
                        continue
                    n = min(window, b - a)
                    s = min(shingle, n)
                    tokens = T.shingle_hashes(h[a:b], np.array([0, b - a]), s)[0].view(np.int64)
                    for k in range(a, b - n + 1):
                        part = tokens[k - a : k - a + n - s + 1]
                        out.append((ids[lo + r], w.text(k, k + n), n, s, part.tolist()))
                columns = list(zip(*out)) or [()] * 5
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))],
                    names=["item", "window", "n", "size", "tokens"],
                )

    return run


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each different window with its words ``n``, shingle ``size``, shingle ``tokens`` by offset and item ids."""
    found = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(
        _windows(window, shingle), "item string, window string, n int, size int, tokens array<long>"
    )
    return found.groupBy("window").agg(
        F.first("n").alias("n"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.collect_set("item").alias("items")
    )


def _matches(w: T.Words, h: np.ndarray, sizes: list[int], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size the places in a run whose shingle is wanted, and those shingles."""
    sieve = np.zeros(1 << 20, bool)
    sieve[wanted >> np.uint64(44)] = True
    for size in sizes:
        tokens, inside = T.shingle_hashes(h, w.rows, size)
        at = np.flatnonzero(sieve[tokens >> np.uint64(44)] & inside)
        at = at[np.isin(tokens[at], wanted)]
        yield size, at, tokens[at]


def _count(sizes: list[int], wanted: "Broadcast") -> Callable:  # noqa: F821
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                w = T.words(data, offsets)
                for _, _, tokens in _matches(w, T.word_hashes(w), sizes, wanted.value):
                    some, n = np.unique(tokens, return_counts=True)
                    total.update(dict(zip(some.view(np.int64).tolist(), n.tolist())))
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    return run


def _candidates(window: int, sizes: list[int], wanted: "Broadcast") -> Callable:  # noqa: F821
    struct = pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("ctx_start", pa.int32()), ("ctx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column(1)):
                w = T.words(data, offsets)
                h = T.word_hashes(w)
                found: list[list] = [[] for _ in range(hi - lo)]
                for _, at, tokens in _matches(w, h, sizes, wanted.value):
                    rows = np.searchsorted(w.rows, at, side="right") - 1
                    for k, r, token in zip(at.tolist(), rows.tolist(), tokens.view(np.int64).tolist()):
                        a, b = int(w.rows[r]), int(w.rows[r + 1])
                        first = max(a, k - window + 1)
                        found[r].append((token, k - a, first - a, w.text(first, min(b, k + window))))
                raw = data.tobytes()
                digests = [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(offsets[:-1], offsets[1:])]
                candidates = pa.array([[dict(zip(("token", "pos", "ctx_start", "ctx"), x)) for x in f] for f in found], pa.list_(struct))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digests, pa.int64()), pa.array(np.diff(w.rows), pa.int64()), candidates],
                    names=["doc_id", "digest", "n_words", "candidates"],
                )

    return run


def _covered(spans: str) -> F.Column:
    """Words that a set of (start, n) spans covers."""
    return F.expr(
        f"aggregate(array_sort({spans}), named_struct('hit', 0L, 'upto', 0L), (a, s) -> named_struct("
        "'hit', a.hit + greatest(0L, s.start + s.n - greatest(a.upto, s.start)),"
        "'upto', greatest(a.upto, s.start + s.n)), a -> a.hit)"
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_tokens: int = BROADCAST_TOKENS,
) -> DataFrame:
    """One row per document row: doc_id, digest (of the text), n_words, n_hit and the ids of items whose windows occur.

    The benchmark's shingles go to every task only up to ``broadcast_tokens`` of them; a larger benchmark is joined
    in blocks of that many, each a pass over the documents.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    windows = materialise(benchmark_windows(benchmark, item_id, text, window, shingle), "windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())
    tokens = materialise(windows.select(F.explode("tokens").alias("token")).distinct(), "window-tokens")

    def blocks(column: DataFrame) -> Iterator[np.ndarray]:
        n = -(-column.count() // broadcast_tokens)
        for k in range(max(n, 1)):
            part = column.where(F.pmod(F.xxhash64("token"), F.lit(max(n, 1))) == k).toArrow().column(0).combine_chunks()
            yield np.sort(part.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    # How often each window shingle occurs in all documents; one that never does rules its windows out.
    counts = None
    for wanted in blocks(tokens):
        part = docs.select("text").mapInArrow(_count(sizes, spark.sparkContext.broadcast(wanted)), "token long, n long")
        counts = part if counts is None else counts.unionByName(part)
    rarity = counts.groupBy("token").agg(F.sum("n").alias("df"))

    # The rarest shingle of a window is its necessary prefix.
    placed = windows.select("window", "n", "size", "items", F.posexplode("tokens").alias("offset", "token"))
    prefix = (
        placed.join(rarity, "token", "left")
        .groupBy("window")
        .agg(
            F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("df", F.lit(0)), "offset")).alias("best"),
            F.min(F.coalesce("df", F.lit(0))).alias("df"),
            F.first("n").alias("n"),
            F.first("size").alias("size"),
            F.first("items").alias("items"),
        )
        .where("df > 0")
        .select(F.col("best.token").alias("token"), F.col("best.offset").alias("offset"), "window", "n", "size", "items")
    )
    prefix = materialise(prefix, "window-prefixes")
    used = [r.size for r in prefix.select("size").distinct().collect()]

    parts = None
    for k, wanted in enumerate(blocks(prefix.select("token").distinct())):
        part = docs.mapInArrow(
            _candidates(window, used, spark.sparkContext.broadcast(wanted)),
            "doc_id long, digest long, n_words long, candidates array<struct<token:long,pos:int,ctx_start:int,ctx:string>>",
        ).withColumn("first_block", F.lit(k == 0))
        parts = part if parts is None else parts.unionByName(part)

    # A document without candidates keeps one row, under a token of its own so that such rows spread evenly.
    each = parts.select(
        "doc_id", "digest", "n_words", "first_block", F.posexplode_outer("candidates").alias("k", "c")
    ).select(
        "doc_id",
        "digest",
        "n_words",
        (F.col("first_block") & (F.coalesce("k", F.lit(0)) == 0)).cast("long").alias("counts"),
        F.coalesce("c.token", F.xxhash64("doc_id", "digest")).alias("token"),
        "c.pos",
        "c.ctx_start",
        "c.ctx",
    )
    by_token = prefix.groupBy("token").agg(F.collect_list(F.struct("offset", "n", "window", "items")).alias("windows"))
    hits = F.expr(
        "filter(windows, w -> pos >= w.offset and pos - w.offset + w.n <= n_words"
        " and array_join(slice(split(ctx, ' '), pos - w.offset - ctx_start + 1, w.n), ' ') = w.window)"
    )
    joined = each.join(by_token, "token", "left").withColumn("hits", F.when(F.col("ctx").isNotNull(), hits))
    grouped = joined.groupBy("doc_id", "digest", "n_words").agg(
        F.sum("counts").alias("copies"),
        F.collect_set(
            F.when(F.size("hits") > 0, F.expr("transform(hits, w -> named_struct('start', cast(pos - w.offset as long), 'n', cast(w.n as long)))"))
        ).alias("spans"),
        F.collect_set(F.when(F.size("hits") > 0, F.expr("flatten(transform(hits, w -> w.items))"))).alias("items"),
    )
    return grouped.select(
        "doc_id",
        "digest",
        "n_words",
        _covered("flatten(spans)").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    )
