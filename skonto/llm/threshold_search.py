"""Ranked lexical search by uniform thresholds over term-partitioned postings (TPUT).

Every term of the items has a list of (document, occurrences, terms of the document). Lists are dealt over the cluster by term, a
long one over several tasks, as packed rows: one for each run of documents. Scores are sums of integer impacts, so bounds are
exact. Three phases, as many for all items of a block at once:

1. The heads of all lists, their ``heads`` highest impacts, give partial sums. The k-th of an item's is a lower bound of its
   k-th score.
2. That bound divided by the item's number of lists is the threshold of all of its lists; a document below it in every
   list can't reach the bound. What is above the threshold is fetched from every list, dealt by runs of documents, and
   summed. A list in which a document was not found adds less than the threshold to it, and no more than its
   highest impact. Documents whose sum with these bounds reaches the k-th highest sum, in their run and then of all, are
   candidates.
3. Their exact scores are looked up in the lists, run by run; the k highest of each run meet in the final order.

Equal scores are all kept to the end, so ties are decided by id. Items are taken in blocks of at most ``PAIRS`` pairs of item and
term, which every task holds; an item of more terms is a block of its own. Nothing of the documents comes to the driver but
counts for each term and bounds for each item.

Defined cases: a null text, or one without terms, has none and is not counted; an item without terms, or whose terms
are in no document, has no rows; items without an id and items that repeat are ranked each; documents without an id
come after those with one if scores are equal, those that repeat an id are ranked each; texts of any length are read
in runs of bounded size; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm import textbytes as T
from skonto.llm.common import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K, HEADS = 10, 100
#: Bytes of text of one run of documents; pairs of item and term of one block; tasks over which a list is dealt.
RUN_BYTES, PAIRS, SPREAD = 8 << 20, 1_000_000, 8


@dataclass(frozen=True)
class Items:
    """A block of items. Item k has the pairs ``first[k]`` to ``first[k + 1]`` of ``term`` and ``times``."""

    terms: list[bytes]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    #: Of each term: weight, and highest impact. Of each item: lower bound of the k-th score.
    weight: np.ndarray
    top: np.ndarray
    bound: np.ndarray
    documents: int = 0
    words: int = 0

    def impact(self, weight: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds to a document's score, for each occurrence in the item."""
        m = 25 + 75 * n.astype(np.int64) * self.documents // max(self.words, 1)
        tf = tf.astype(np.int64)
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))

    def pairs(self, item: int) -> slice:
        return slice(self.first[item], self.first[item + 1])

    def lists(self) -> np.ndarray:
        """How many lists each item has in which anything can be found."""
        item = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.bincount(item[self.weight[self.term] > 0], minlength=len(self.first) - 1)

    def thresholds(self) -> np.ndarray:
        """Of each pair, the least impact that makes the uniform threshold of its item."""
        item = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        shares = np.maximum(self.lists()[item] * self.times, 1)
        return -(-self.bound[item] // shares)

    def caps(self) -> np.ndarray:
        """Of each pair, the most that a document below its threshold gets."""
        return np.maximum(np.minimum(self.thresholds() - 1, self.top[self.term]), 0) * self.times


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """(item, term, times) of the numbered ``items``."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return items.select("item", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


POSTINGS = "term int, run long, docs array<int>, tf array<int>, n array<int>, ids array<long>"


def _postings(terms: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows of all terms for each run of documents; the row of term -1 has the documents' ids and sizes."""
    wanted = pa.array(terms, pa.large_binary())
    names = [c.split()[0] for c in POSTINGS.split(", ")]

    def packed(run: int, ids: pa.Array, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(term, prepend=-2))
        at = pa.array(np.concatenate([[0], [len(n)], len(n) + np.append(first[1:], len(term))]) if len(term) else np.array([0, len(n)]), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([a, b]), pa.int32())) for a, b in ((np.arange(len(n)), doc), (np.zeros(len(n)), tf), (n, n[doc]))]
        held = pa.array([ids.to_pylist(), *[None] * len(first)], pa.list_(pa.int64()))
        return pa.record_batch([pa.array(np.concatenate([[-1], term[first]]), pa.int32()), pa.array(np.full(1 + len(first), run), pa.int64()), *lists, held], names=names)

    def counted(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = T.distinct(w)
        known = pc.fill_null(pc.index_in(found.dictionary, wanted), -1).to_numpy(zero_copy_only=False)
        term = known[found.indices.to_numpy()]
        docs = len(w.rows) - 1
        doc = np.repeat(np.arange(docs), np.diff(w.rows))
        key, tf = np.unique(term[term >= 0].astype(np.int64) * docs + doc[term >= 0], return_counts=True)
        return key // docs, key % docs, tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            long, sums, size = -1, np.zeros(len(terms), np.int64), 0  # a text that goes over several runs of words

            def whole() -> pa.RecordBatch:
                term = np.flatnonzero(sums)
                return packed(int(rows[long]), ids.slice(long, 1), np.array([size]), term, np.zeros(len(term), np.int64), sums[term])

            for lo, hi, w, part, _ in T.word_runs(batch.column(2), RUN_BYTES):
                if long >= 0 and (part <= 1 or lo != long):
                    yield whole()
                    long = -1
                if part == 0:
                    yield packed(int(rows[lo]), ids.slice(lo, hi - lo), np.diff(w.rows), *counted(w))
                    continue
                if part == 1:
                    long, sums, size = lo, np.zeros(len(terms), np.int64), 0
                term, _, tf = counted(w)
                sums[term] += tf
                size += len(w.starts)
            if long >= 0:
                yield whole()

    return run


def _values(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _heads(items: Items, heads: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The highest impacts of each list, as far as it is in this task; rows of a term follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = -1, np.zeros((0, 3), np.int64)
        out: list[np.ndarray] = []

        def cut(x: np.ndarray) -> np.ndarray:
            return x[np.argpartition(-x[:, 2], heads)[:heads]] if len(x) > heads else x

        for batch in batches:
            terms, runs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(len(batch)):
                term = int(terms[k])
                impact = items.impact(items.weight[term], _values(batch.column(3), k), _values(batch.column(4), k))
                docs = _values(batch.column(2), k)
                some = cut(np.column_stack([np.full(len(docs), runs[k]), docs, impact]))
                if term != last:
                    if len(best):
                        out.append(np.column_stack([np.full(len(best), last), best]))
                    last, best = term, np.zeros((0, 3), np.int64)
                best = cut(np.concatenate([best, some]))
            if len(out) > 1000:
                yield pa.record_batch([pa.array(c) for c in np.concatenate(out).T], names=["term", "run", "doc", "impact"])
                out = []
        if len(best):
            out.append(np.column_stack([np.full(len(best), last), best]))
        if out:
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=["term", "run", "doc", "impact"])

    return run


def _above(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each packed row what is above the least threshold of the items that have its term."""
    least = np.full(len(items.terms), np.iinfo(np.int64).max)
    np.minimum.at(least, items.term, items.thresholds())
    least = np.maximum(least, 1)  # what adds nothing is not needed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, kept = batch.column(0).to_numpy(), []
            for k, term in enumerate(terms):
                impact = items.impact(items.weight[term], _values(batch.column(3), k), _values(batch.column(4), k))
                over = impact >= least[term]
                if over.any():
                    kept.append((int(term), batch.column(1)[k].as_py(), _values(batch.column(2), k)[over], impact[over]))
            columns = list(zip(*kept)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["term", "run", "docs", "impact"])

    return run


def _of_items(terms: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Items that have any of the ``terms``: the item, its pairs, and where their terms are in ``terms``."""
    place = np.full(len(items.terms), -1)
    place[terms] = np.arange(len(terms))
    at = place[items.term]
    pair = np.flatnonzero(at >= 0)
    item = np.searchsorted(items.first, pair, side="right") - 1
    for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(item)) + 1) if len(pair) else ():
        yield int(item[part[0]]), pair[part], at[pair[part]]


CANDIDATES = "item int, run long, docs array<int>, most array<long>, best array<long>"


def _candidates(items: Items, k: int) -> Callable[[pa.Table], pa.Table]:
    """Sums over one run of documents; what may be among an item's k highest, and the k highest sums."""
    threshold, cap = items.thresholds(), items.caps()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        terms, run_of = rows["term"].to_numpy(), rows["run"][0].as_py()
        docs, impacts = ([x.values.to_numpy() for x in rows[c]] for c in ("docs", "impact"))
        size, out = 1 + max(int(d.max()) for d in docs), []
        for item, pairs, at in _of_items(terms, items):
            low, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for p, a in zip(pairs, at):
                over = impacts[a] >= threshold[p]
                where = docs[a][over]  # a list has a document once
                low[where] += items.times[p] * impacts[a][over]
                seen[where] += cap[p]
            found = np.flatnonzero(low)
            if not len(found):
                continue
            low = low[found]
            most = low + cap[items.pairs(item)].sum() - seen[found]
            best = -np.sort(-low)[:k]
            reach = max(int(items.bound[item]), int(best[-1]) if len(best) == k else 0)
            may = most >= reach
            out.append((item, run_of, found[may], most[may], best))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["item", "run", "docs", "most", "best"])

    return run


def _exact(items: Items, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of the candidates of a run, looked up in the rows of its lists; the k highest of each item."""

    def run(candidates: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
        rows = rows.combine_chunks()
        terms = rows["term"].to_numpy()
        where = {int(t): r for r, t in enumerate(terms)}
        if candidates.num_rows and -1 in where:
            ids = rows["ids"][where[-1]].values
            docs, tf, n = (rows[c] for c in ("docs", "tf", "n"))
            for item, wanted, most in zip(candidates["item"].to_pylist(), candidates["docs"], candidates["most"]):
                wanted = wanted.values.to_numpy()[most.values.to_numpy() >= items.bound[item]]
                score = np.zeros(len(wanted), np.int64)
                for p in range(items.first[item], items.first[item + 1]):
                    if (r := where.get(int(items.term[p]))) is None or not len(wanted):
                        continue
                    have = docs[r].values.to_numpy()
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    hit = have[at] == wanted
                    at = at[hit]
                    score[hit] += items.times[p] * items.impact(items.weight[items.term[p]], tf[r].values.to_numpy()[at], n[r].values.to_numpy()[at])
                own = ids.take(pa.array(wanted))
                named = np.array([x is None for x in own.to_pylist()], bool)
                order = np.lexsort((own.fill_null(0).to_numpy(), named, -score))[:k]
                order = order[score[order] > 0]
                out["item"] += [item] * len(order)
                out["doc_id"] += own.take(pa.array(order)).to_pylist()
                out["score"] += score[order].tolist()
        return pa.table([pa.array(out["item"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["score"], pa.int64())], names=list(out))

    return run


def _kth(rows: DataFrame, k: int, items: int) -> np.ndarray:
    """The k-th highest ``low`` of each item, 0 if there are fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    out = np.zeros(items, np.int64)
    for r in rows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", "low").collect():
        out[r["item"]] = r["low"]
    return out


def _searched(spark: SparkSession, documents: DataFrame, items: Items, k: int, heads: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items; ``documents`` are (_row, doc_id, text)."""
    dealt = documents.mapInArrow(_postings(items.terms), POSTINGS).repartition("term", F.pmod(F.xxhash64("run"), F.lit(SPREAD)))
    postings = materialise(dealt.sortWithinPartitions("term", "run"), "postings")
    of_list = postings.groupBy("term").agg(
        F.sum(F.size("docs")).alias("df"),
        F.sum(F.when(F.col("term") == -1, F.size(F.filter("n", lambda x: x > 0)))).alias("some"),
        F.sum(F.when(F.col("term") == -1, F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).alias("words"),
    )
    df, some, words = np.zeros(len(items.terms)), 0, 0
    for r in of_list.collect():
        if r.term == -1:
            some, words = r.some, r.words
        else:
            df[r.term] = r.df
    weight = [math.floor(1000 * math.log((2.0 * some + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()]
    items = replace(items, weight=np.array(weight, np.int64), documents=some, words=words)
    lists = postings.where("term >= 0")

    found = lists.mapInArrow(_heads(items, heads), "term long, run long, doc long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "run", "doc"))
    head = materialise(found.withColumn("place", place).where(F.col("place") <= heads).drop("place"), "list-heads")
    top = np.zeros(len(items.terms), np.int64)
    for r in head.groupBy("term").agg(F.max("impact").alias("top")).collect():
        top[r.term] = r.top
    of_pair = pa.table({"item": np.repeat(np.arange(len(items.first) - 1), np.diff(items.first)), "term": items.term, "times": items.times})
    pairs = F.broadcast(spark.createDataFrame(of_pair))  # a block's, PAIRS at most but for a single item
    sums = head.join(pairs, "term").groupBy("item", "run", "doc").agg(F.sum(F.col("times") * F.col("impact")).alias("low"))
    items = replace(items, top=top, bound=_kth(sums, k, len(items.bound)))

    above = lists.mapInArrow(_above(items), "term int, run long, docs array<int>, impact array<long>")
    candidates = materialise(above.groupBy("run").applyInArrow(_candidates(items, k), CANDIDATES), "candidates")
    second = _kth(candidates.select("item", F.explode("best").alias("low")), k, len(items.bound))
    items = replace(items, bound=np.maximum(items.bound, second))

    bounds = F.broadcast(spark.createDataFrame(pa.table({"item": np.arange(len(items.bound)), "bound": items.bound})))
    left = materialise(candidates.join(bounds, "item").where(F.array_max("most") >= F.col("bound")).select("item", "run", "docs", "most"), "candidates-left")
    needed = postings.join(left.select("run").distinct(), "run", "left_semi")
    scored = left.groupBy("run").cogroup(needed.groupBy("run")).applyInArrow(_exact(items, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = K, heads: int = HEADS, pairs: int = PAIRS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents of highest score for each item row."""
    spark = documents.sparkSession
    docs = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "items")
    terms = materialise(item_terms(numbered, "text"), "item-terms")
    blocks = max(1, -(-terms.count() // pairs))
    out = None
    for b in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        if not block.num_rows:
            continue
        names, item = np.unique(block["item"].to_numpy(), return_inverse=True)
        vocabulary = pc.unique(block["term"]).sort()
        term = pc.index_in(block["term"], vocabulary).to_numpy()
        first = np.searchsorted(item, np.arange(len(names) + 1))
        none = np.zeros(len(vocabulary), np.int64)
        held = Items([x.encode() for x in vocabulary.to_pylist()], first, term, block["times"].to_numpy(), none, none, np.zeros(len(names), np.int64))
        found = _searched(spark, docs, held, k, heads)
        of_item = F.broadcast(spark.createDataFrame(pa.table({"item": np.arange(len(names)), "number": names})))
        part = found.join(of_item, "item").select("number", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out.join(numbered.select(F.col("item").alias("number"), "item_id"), "number").select("item_id", "rank", "doc_id", "score")
