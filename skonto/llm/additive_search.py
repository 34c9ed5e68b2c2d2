"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional code word from each of several codebooks. The codebooks are
trained on a bounded sample: residual k-means gives a start, then beam-search encoding and a least-squares update of
all code words alternate. Every vector is encoded by beam search and stored as its codes and the norm of their sum.

Directions are quantised: a vector is stored as the codes of its unit vector, its length, and how far the sum of its words
is from the unit vector. A search looks at every code: for a block of queries the inner products with all code words make
lookup tables, and a vector's approximate score is the sum of its codes' entries times its length. By Cauchy and Schwarz
the true score is off by no more than the stored distance allows. So the best of a block by approximate score are scored
exactly, and then every other vector that could still be as good as the last of those wanted. What the codes rule out
can't be an answer; how much they rule out depends on the data, the answer doesn't. Exact scores are made in double
precision from vectors as stored.

Equal vectors are indexed once, with as many of their smallest ids as an answer can hold. Equal queries are
searched once.

Defined cases: vectors that are null, zero, of another length than most (ties: the shorter), or hold null or non-finite
components take no part, neither do rows without an id; rows that repeat id and vector count once; an id with several
vectors asks with the smallest of them and may be found with each; a query's own id is never its
neighbour; fewer candidates than wanted are all found; columns other than the named ones are ignored, whatever they are
called; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from skonto.llm.common import materialise

INNER, DISTANCE = "inner", "distance"
CODEBOOKS, WORDS, BEAM = 32, 64, 2
#: Vectors that train the codebooks, about; one task fits them.
SAMPLE = 8192
#: Codes of a block of candidates, queries of a block, and the least number of blocks of each.
CANDIDATES, QUERIES, LEAST_CANDIDATES, LEAST_QUERIES = 131_072, 65_536, 2, 3
#: A block of vectors as doubles has so many bytes at most.
BLOCK_BYTES = 1 << 26
#: So many vectors of a block are scored exactly for each query before the others are judged by their bounds.
SHORTLIST = 320


@dataclass
class Codebooks:
    """``words[m, k]`` is word k of codebook m."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of the rows of ``x``: after each codebook the ``beam`` best partial sums stay."""
        m, k, _ = self.words.shape
        flat = self.words.reshape(m * k, -1).astype(np.float32)
        gram = flat @ flat.T
        out = np.empty((len(x), m), np.uint8 if k <= 256 else np.uint16)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024].astype(np.float32)
            n = len(part)
            against = part @ flat.T
            codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
            for level in range(m):
                at = slice(level * k, (level + 1) * k)
                # |r - c|^2 - |r|^2 with r = x - sum of the words so far
                step = np.diag(gram)[at] - 2 * against[:, None, at]
                step = np.repeat(step, codes.shape[1], axis=1)
                for earlier in range(level):
                    step += 2 * gram[earlier * k + codes[:, :, earlier], at]
                total = (error[:, :, None] + step).reshape(n, -1)
                keep = min(beam, total.shape[1]) if level + 1 < m else 1
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(total, best, axis=1)
                before = np.take_along_axis(codes, (best // k)[:, :, None], axis=1)
                codes = np.concatenate([before, (best % k)[:, :, None]], axis=2)
            out[lo : lo + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of words that codes stand for."""
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[codebook, word, query]: inner products."""
        return np.einsum("mkd,qd->mkq", self.words, queries, optimize=True).astype(np.float32)

    @property
    def rounding(self) -> float:
        """What single precision may add to the score of a unit query and a sum of words."""
        m, _, d = self.words.shape
        return 2.0**-22 * (m + d) * float(np.linalg.norm(self.words.astype(np.float64), axis=2).max(axis=1).sum()) + 1e-9


def fit(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 2, seed: int = 7) -> Codebooks:
    """Codebooks for the rows of ``sample``."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    rest, levels = x.copy(), []
    for _ in range(codebooks):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(6):
            near = np.argmax(rest @ centre.T - (centre**2).sum(1) / 2, axis=1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            total = np.zeros_like(centre)
            full = np.flatnonzero(count)
            total[full] = np.add.reduceat(rest[order], np.concatenate([[0], np.cumsum(count)[:-1]])[full], axis=0)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.integers(0, len(rest), words)])
        near = np.argmax(rest @ centre.T - (centre**2).sum(1) / 2, axis=1)
        rest -= centre[near]
        levels.append(centre)
    model = Codebooks(np.stack(levels))
    for _ in range(rounds):
        codes = model.encode(x, beam).astype(np.int64) + np.arange(codebooks) * words
        together = np.zeros((codebooks * words,) * 2)
        for a in range(codebooks):
            for b in range(codebooks):
                np.add.at(together, (codes[:, a], codes[:, b]), 1)
        moments = np.zeros((codebooks * words, x.shape[1]))
        for a in range(codebooks):
            np.add.at(moments, codes[:, a], x)
        # ridge towards the words as they are keeps words that nothing uses
        ridge = 0.1 * len(x) / (codebooks * words)
        old = model.words.reshape(codebooks * words, -1)
        new = np.linalg.solve(together + ridge * np.eye(len(together)), moments + ridge * old)
        model = Codebooks(new.reshape(model.words.shape).astype(np.float32))
    return model


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are not zero in double precision at length one, and their lengths; the square of no component overflows."""
    most = np.abs(x).max(axis=1, keepdims=True).astype(np.float64)
    y = x / most
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return y / size, (most * size)[:, 0]


def _fit(dimension: int, codebooks: int, words: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = units(np.concatenate([_matrix(batch.column(0), dimension) for batch in batches if batch.num_rows]))[0]
        order = np.lexsort(x.T)  # the same codebooks in whatever order rows arrive
        yield pa.record_batch([pa.array([fit(x[order], codebooks, words, beam).words.astype(np.float32).tobytes()], pa.binary())], names=["words"])

    return run


def _encode(model: Codebooks, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, size = units(_matrix(batch.column("vector"), model.words.shape[2]))
            codes = model.encode(x, beam)
            off = np.linalg.norm(x - model.decode(codes).astype(np.float64), axis=1)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            columns = [batch.column(c) for c in ("key", "vector", "ids")] + [packed, pa.array(size), pa.array(off)]
            yield pa.record_batch(columns, names=["key", "vector", "ids", "codes", "size", "off"])

    return run


def exact(measure: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of matching rows in double precision, added in the order of the components."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    terms = q * v if measure == INNER else -((q - v) ** 2)
    return np.cumsum(terms, axis=-1)[..., -1]


def _scan(model: Codebooks, measure: str, shortlist: int, wanted: int) -> Callable[[pa.Table], pa.Table]:
    """The ``wanted`` nearest ids in a block of candidates for each query of a block."""
    dimension = model.words.shape[2]

    def run(t: pa.Table) -> pa.Table:
        is_query = t["codes"].is_null().to_numpy()
        asked, held = t.filter(pa.array(is_query)), t.filter(pa.array(~is_query))
        keys, found, scores = asked["key"].to_numpy(), [], []
        if len(held) and len(asked):
            codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8 if model.words.shape[1] <= 256 else np.uint16).reshape(len(held), -1)
            ids, size = held["ids"].combine_chunks(), held["size"].to_numpy()
            first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            reach = size * (held["off"].to_numpy() + model.rounding)
            v, q = _matrix(held["vector"].combine_chunks(), dimension).astype(np.float64), _matrix(asked["vector"].combine_chunks(), dimension).astype(np.float64)
            keep, last = min(shortlist, len(v)), min(wanted, len(v))
            for lo in range(0, len(q), 64):
                unit, length = units(q[lo : lo + 64])
                tables = model.tables(unit.astype(np.float32))
                near = tables[0][codes[:, 0]]
                for m in range(1, len(tables)):
                    near += tables[m][codes[:, m]]
                for k, mine in enumerate(q[lo : lo + 64]):
                    about, margin = near[:, k] * (size * length[k]), reach * length[k]
                    if measure == DISTANCE:
                        about, margin = 2 * about - size**2 - length[k] ** 2, 2 * margin + 1e-12 * (size**2 + length[k] ** 2)
                    some = np.argpartition(about, len(v) - keep)[len(v) - keep :]
                    least = np.sort(exact(measure, mine[None, :], v[some]))[-last] if keep >= last else -np.inf
                    row = np.flatnonzero(~(about + margin < least))  # what is not a number is judged by its exact score
                    if len(row) > 4 * keep:  # a product in whatever order leaves few to be added in theirs
                        inner = v[row] @ mine
                        again = inner if measure == INNER else 2 * inner - size[row] ** 2 - length[k] ** 2
                        error = 1e-14 * dimension * (length[k] * size[row] if measure == INNER else (length[k] + size[row]) ** 2)
                        row = row[~(again + error < least)]
                    score = exact(measure, mine[None, :], v[row])
                    best = np.lexsort((first[row], -score))[:wanted]
                    every = sorted((-float(score[j]), i) for j in best for i in ids[int(row[j])].as_py())[:wanted]
                    found.append([i for _, i in every])
                    scores.append([-far for far, _ in every])
        return pa.table({"key": keys[: len(found)], "found": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vector) of the rows that take part, before the test of the length; floats stay floats, all else is double."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"))
    if rows.schema["vector"].dataType != ArrayType(FloatType()):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(sound)


def nearest(
    vectors: DataFrame,
    queries: Column,
    wanted: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    measure: str = INNER,
    codebooks: int = CODEBOOKS,
    words: int = WORDS,
    beam: int = BEAM,
    sample: int = SAMPLE,
    shortlist: int = SHORTLIST,
    block_candidates: int = CANDIDATES,
    block_queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``wanted`` nearest rows of each query, nearest first, ties to the smaller id.

    ``queries`` is a condition on the column ``id``; ``measure`` is the inner product or the negative squared distance.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return empty
    rows = rows.where(F.size("vector") == common.d)

    # An answer holds at most wanted ids of one vector, besides the query's own.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    some = rows.distinct().withColumn("k", order).where(F.col("k") <= wanted + 1)
    distinct = materialise(
        some.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id()), "vectors"
    )
    kind = distinct.schema["vector"].dataType.simpleString()
    n = distinct.count()
    draw = F.pmod(F.xxhash64("vector", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = distinct.where(draw < sample / n).select("vector")
    if not drawn.limit(1).count():  # of few vectors a draw may leave none
        drawn = distinct.select("vector").limit(sample)
    fitted = drawn.repartition(1).mapInArrow(_fit(common.d, codebooks, words, beam), "words binary").first().words
    model = Codebooks(np.frombuffer(fitted, np.float32).reshape(codebooks, words, common.d))
    coded = distinct.select("key", "vector", "ids").mapInArrow(_encode(model, beam), f"key long, vector {kind}, ids array<long>, codes binary, size double, off double")

    asked = rows.where(queries).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    different = materialise(distinct.join(asked.select("vector").distinct(), "vector", "left_semi").select("key", "vector"), "queries")
    n_different = different.count()
    fits = max(1024, BLOCK_BYTES // (8 * common.d))
    n_candidates, n_queries = max(LEAST_CANDIDATES, -(-n // min(block_candidates, fits))), max(LEAST_QUERIES, -(-n_different // min(block_queries, fits)))
    deal = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = coded.withColumn("c", deal(n_candidates)).withColumn("q", all_of(n_queries))
    posed = different.withColumn("q", deal(n_queries)).withColumn("c", all_of(n_candidates))
    block = held.unionByName(posed, allowMissingColumns=True)
    near = block.groupBy("q", "c").applyInArrow(_scan(model, measure, shortlist, wanted + 1), "key long, found array<long>, scores array<double>")
    ranked = F.transform(F.arrays_zip("scores", "found"), lambda x: F.struct((-x["scores"]).alias("far"), x["found"].alias("id")))
    lists = near.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list(ranked))), 1, wanted + 1).alias("near"))
    best = different.join(lists, "key").select("vector", "near")
    # a hot vector's queries spread over tasks, as their join splits
    answers = asked.join(best, "vector").select(
        "query_id", F.posexplode(F.slice(F.array_sort(F.filter("near", lambda x: x["id"] != F.col("query_id"))), 1, wanted)).alias("k", "x")
    )
    return answers.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def brute_force(vectors: DataFrame, queries: Column, wanted: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The true answer for the inner product, for measuring recall with a few queries: each is compared with every row."""
    rows = usable(vectors, vec_id, embedding)
    asked = rows.where(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    score = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = rows.join(F.broadcast(asked), F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
