"""Self join of texts on the Jaccard similarity of their word n-grams, by MinHash banding.

Texts with the same n-gram set are one class. Each class has a MinHash signature cut into bands; classes with an
equal band meet in a bucket. A bucket gives only links from its members to its smallest member, so a bucket of n
gives n - 1 rows; the components of these links hold every pair that shares a band. Within a component pairs are
verified on the full n-gram sets, in blocks of bounded size, and only counts and spanning links leave a block. Two sets of
n and m n-grams can only reach a similarity s if ``s n <= m``: a component is cut into classes of sizes a factor 1 / s apart,
and a block meets the blocks of its own class and of the next one.

Defined cases: a text of fewer words than an n-gram has one n-gram of all its words; a null or wordless text has none,
is similar to nothing and is its own class; a row without an id is no document: it is returned without class and
links; rows that repeat an id, with its text or with another, count as documents of their own with that id; columns
other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.llm import textbytes as T
from skonto.llm.common import materialise
from skonto.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Most MinHash values of a signature.
HASHES = 128
#: A block of a component's size class holds about so many n-grams and so many texts.
BLOCK_NGRAMS = 1_000_000
BLOCK_TEXTS = 512
#: n-grams in more texts of a block than this are counted by matrix products, the others pair by pair.
COMMON = 48


def bands_and_rows(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most selective banding that finds a pair of just this similarity with this probability at least.

    With more rows a band fewer dissimilar pairs meet; bands are added until ``1 - (1 - s^rows)^bands`` reaches the
    recall, as far as ``hashes`` values go.
    """
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _signatures(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    factors = T.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * T.STEP) | np.uint64(1)
    places = T._powers(T.BASE, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column(1), 1 << 18):
                w = T.words(data, offsets)
                s, at = T.text_shingles(T.word_hashes(w), w.rows, size)
                full = np.flatnonzero(np.diff(at))
                keys: list = [None] * (hi - lo)
                count = np.zeros(hi - lo, np.int32)
                for r in full.tolist():
                    own = np.unique(s[at[r] : at[r + 1]])
                    keys[r], count[r] = xxhash.xxh3_128_digest(own.tobytes()), len(own)
                hashed: list = [None] * (hi - lo)
                if len(full):
                    least = np.empty((bands * rows, len(full)), np.uint64)
                    for k, factor in enumerate(factors):
                        least[k] = np.minimum.reduceat(s * factor, at[full])
                    joined = (least.reshape(bands, rows, -1) * places[None, :, None]).sum(axis=1, dtype=np.uint64)
                    joined = T.mix(joined + np.arange(bands, dtype=np.uint64)[:, None] * T.STEP).view(np.int64).T
                    for r, x in zip(full.tolist(), joined.tolist()):
                        hashed[r] = x
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(count), pa.array(hashed, pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "ngrams", "n", "bands"],
                )

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sorted n-gram set of each text as bytes, beside the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            for lo, hi, data, offsets in T.chunks(batch.column("text")):
                w = T.words(data, offsets)
                s, at = T.text_shingles(T.word_hashes(w), w.rows, size)
                own = [np.unique(s[at[r] : at[r + 1]]).tobytes() for r in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*(part.column(x) for x in names), pa.array(own, pa.binary())], names=[*names, "grams"])

    return run


def shared_counts(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams the sets ``left`` have in common with the sets ``right``: a matrix, one row for each of left."""
    both = np.unique(np.concatenate([left, right]))
    owner = np.repeat(both, [len(grams[i]) for i in both])
    values = np.concatenate([grams[i] for i in both]) if len(both) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    count = np.diff(np.append(first, len(values)))
    row, column = np.full(len(grams), -1), np.full(len(grams), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.int64)

    # n-grams of few texts: their pairs one place further apart at a time
    group = np.repeat(np.arange(len(first)), count)
    rare = count[group] <= COMMON
    g, o = group[rare], owner[rare]
    for step in range(0, COMMON):
        if step >= len(g):
            break
        same = np.flatnonzero(g[: len(g) - step] == g[step:])
        if not len(same):
            break
        for x, y in ((o[same], o[same + step]), (o[same + step], o[same])) if step else ((o[same], o[same]),):
            x, y = row[x], column[y]
            ok = (x >= 0) & (y >= 0)
            out += np.bincount(x[ok] * len(right) + y[ok], minlength=out.size).reshape(out.shape)

    # n-grams of many texts: products of 0/1 matrices
    dense = np.flatnonzero(count > COMMON)
    for k in range(0, len(dense), 2048):
        part = dense[k : k + 2048]
        cell = np.concatenate([np.arange(first[c], first[c] + count[c]) for c in part])
        col = np.repeat(np.arange(len(part)), count[part])
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        x, y = row[owner[cell]], column[owner[cell]]
        a[x[x >= 0], col[x >= 0]] = 1
        b[y[y >= 0], col[y >= 0]] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def size_class(n: Column, similarity: float) -> Column:
    """The class of a set of ``n``: sizes of which one is at most ``1 / similarity`` times the other are of one class or neighbours."""
    # the small step keeps sizes that lie just on an edge, where the logarithm may round down, within the next class
    width = math.log(1 / similarity) + 1e-9 if similarity < 1 else 1e-6
    return F.floor(F.log(n) / width).cast("int")


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the smallest text that it reaches by links between left and right."""
    root = np.full(n, -1)
    for i in np.union1d(left, right):
        if root[i] >= 0:
            continue
        root[i] = i
        a, b = np.flatnonzero(left == i), np.flatnonzero(right == i)
        while len(a) or len(b):
            to_right = right[linked[a].any(axis=0)] if len(a) else right[:0]
            to_left = left[linked[:, b].any(axis=1)] if len(b) else left[:0]
            new = np.union1d(to_right, to_left)
            new = new[root[new] < 0]
            root[new] = i
            a, b = np.flatnonzero(np.isin(left, new)), np.flatnonzero(np.isin(right, new))
    return root


def _verify(similarity: float) -> Callable[[pa.Table], pa.Table]:
    s = Fraction(similarity).limit_denominator(10_000)

    def run(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        rep, keep = np.unique(rep, return_index=True)
        copies, is_right = t["copies"].to_numpy()[keep], t["right"].to_numpy(zero_copy_only=False)[keep]
        grams = t["grams"].take(pa.array(keep)).to_pylist()
        grams = [np.frombuffer(x, np.uint64) for x in grams]
        alone = not t["across"][0].as_py() and t["i"][0].as_py() == t["j"][0].as_py()
        left, right = np.flatnonzero(~is_right), np.flatnonzero(is_right | alone)
        n = np.array([len(x) for x in grams], np.int64)
        both = n[left][:, None] + n[right][None, :]
        linked = (s.numerator + s.denominator) * shared_counts(grams, left, right) >= s.numerator * both
        linked &= both > 0
        links = np.zeros(len(rep), np.int64)
        if alone:
            np.fill_diagonal(linked, False)
            links[left] = linked @ copies[right]
        else:
            links[left] = linked @ copies[right]
            links[right] = linked.T @ copies[left]
        root = rep[_roots(linked, left, right, len(rep))]
        return pa.table({"rep": rep, "links": links, "root": root})

    return run


def jaccard_join(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    hashes: int = HASHES,
    block_ngrams: int = BLOCK_NGRAMS,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """One row per document row: doc_id, class_id and n_links.

    ``class_id`` is the smallest doc_id among the documents that chains of similar pairs lead to, ``n_links`` the number
    of other documents whose similarity is ``similarity`` or more.
    """
    bands, rows = bands_and_rows(similarity, recall, hashes)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    to_sign = docs.select("doc_id", "text", "digest")
    signed = materialise(to_sign.mapInArrow(_signatures(words, bands, rows), "doc_id long, digest binary, ngrams binary, n int, bands array<long>"), "signatures")
    named = signed.where("doc_id is not null and ngrams is not null")
    # An id may stand for several texts, so a class has a number of its own and is found again by id and digest.
    classes = materialise(
        named.groupBy("ngrams")
        .agg(
            F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
        .select("ngrams", F.monotonically_increasing_id().alias("rep"), "first.doc_id", "first.digest", "copies", "n", "bands"),
        "ngram-classes",
    )

    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    stars = banded.join(buckets, "band").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    candidate = components(stars)

    members = candidate.join(classes.select("rep", "doc_id", "digest", "copies", "n"), candidate.node == F.col("rep")).select("rep", "doc_id", "digest", "label", "copies", "n")
    # Each n-gram set goes to the blocks of its size class and to the meetings with those of the class below and above.
    sized = members.withColumn("size", size_class(F.col("n"), similarity))
    blocks = sized.groupBy("label", "size").agg(
        F.greatest(F.ceil(F.sum("n") / block_ngrams), F.ceil(F.count("*") / block_texts)).cast("int").alias("blocks")
    )
    around = lambda name, step: blocks.select("label", (F.col("size") + step).alias("size"), F.col("blocks").alias(name))
    placed = (
        sized.join(blocks, ["label", "size"])
        .join(around("below", 1), ["label", "size"], "left")
        .join(around("above", -1), ["label", "size"], "left")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block, missing = F.col("block"), F.lit(0)
    within = F.transform(upto(F.col("blocks")), lambda k: F.struct(F.col("size").alias("size"), F.lit(False).alias("across"), F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (block > k).alias("right")))
    upward = F.transform(upto(F.coalesce("above", missing)), lambda k: F.struct(F.col("size").alias("size"), F.lit(True).alias("across"), block.alias("i"), k.alias("j"), F.lit(False).alias("right")))
    downward = F.transform(upto(F.coalesce("below", missing)), lambda k: F.struct((F.col("size") - 1).alias("size"), F.lit(True).alias("across"), k.alias("i"), block.alias("j"), F.lit(True).alias("right")))
    held = docs.join(placed.select("rep", "doc_id", "digest", "label", "copies", F.concat(within, upward, downward).alias("meets")), ["doc_id", "digest"]).select("rep", "label", "copies", "meets", "text")
    meet = "array<struct<size:int,across:boolean,i:int,j:int,right:boolean>>"
    sets = held.mapInArrow(_sets(words), f"rep long, label long, copies long, meets {meet}, grams binary")
    paired = sets.select("rep", "label", "copies", "grams", F.inline("meets"))
    verified = materialise(
        paired.groupBy("label", "size", "across", "i", "j").applyInArrow(_verify(similarity), "rep long, links long, root long"), "verified"
    )
    joined = components(verified.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))

    labels = joined.withColumnRenamed("node", "rep")
    smallest = labels.join(classes.select("rep", "doc_id"), "rep").groupBy("label").agg(F.min("doc_id").alias("smallest"))

    known = (
        classes.select("ngrams", "rep", "doc_id", "copies")
        .join(links, "rep", "left")
        .join(labels.join(smallest, "label"), "rep", "left")
        .select("ngrams", F.coalesce("smallest", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    with_words = named.select("doc_id", "ngrams").join(known, "ngrams", "left").select("doc_id", "class_id", "n_links")
    without = signed.where("doc_id is null or ngrams is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return with_words.unionByName(without)
