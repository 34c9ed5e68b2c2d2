"""Exact groups, ranked search and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skonto.llm import block_names, importance, op11, op12, op13, textbytes, threshold_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use themselves.
DOCS = "doc_id long, text string, _row long, name long, n int, rank string, score double, item string, block string, level int, run int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, "x", 0.5, "y", "z", 2, 3) for i, t in rows], DOCS)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def random_rows(seed, n=60, size=80, vocabulary=150):
    rng = np.random.default_rng(seed)
    text = lambda: " ".join(f"W{int(k * k) % vocabulary}é" for k in rng.integers(0, vocabulary, rng.integers(0, size)))
    rows = [(k, text()) for k in range(n)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(20)] + [(3, rows[3][1]), (3, rows[3][1]), (3, text()), (None, rows[1][1]), (None, None), (200, None), (201, ""), (202, " \t\n"), (203, "?!"), (None, "?!")]
    return rows + [(300, rows[5][1].replace(" ", "  ")), (301, rows[5][1].replace(" ", "\n")), (2, " " + rows[5][1].replace(" ", "\x0b"))]


# ---- exact groups


def groups(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    of = defaultdict(list)
    for i, t in rows:
        of[key(t)].append((-len(t or ""), i is None, i or 0))
    out = Counter()
    for k, members in of.items():
        digest, first = hashlib.sha256(k.encode()).hexdigest(), min(members)
        for j, (_, none, i) in enumerate(sorted(members)):
            out[(None if none else i, None if first[1] else first[2], len(members), j == 0, digest)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize(("size", "hot"), [(4, 2), (16, 1024), (2048, 1024)])
def test_exact_groups(spark, size, hot):
    rows = random_rows(1) + [(400 + k, "ab" * 50) for k in range(30)] + [(500 + k, "ab" * k) for k in range(12)]
    assert found(block_names.exact_groups(docs(spark, rows), size=size, hot=hot)) == groups(rows)


def test_names_don_t_rest_on_hashes(spark, monkeypatch):
    """All blocks in one bucket, all of them common, with a hash that two different blocks share."""
    monkeypatch.setattr(block_names, "BUCKETS", 1)
    rows = random_rows(2)
    cut = block_names.blocks_of
    monkeypatch.setattr(block_names, "blocks_of", lambda r, s: cut(r, s).withColumn("hash", block_names.F.pmod("hash", block_names.F.lit(3))))
    assert found(block_names.exact_groups(docs(spark, rows), size=8)) == groups(rows)


def test_exact_long_and_empty(spark):
    long = "x y" * 400_000
    rows = [(1, long), (2, long + " "), (3, long + "z"), (4, long[:-1])]
    assert found(block_names.exact_groups(docs(spark, rows))) == groups(rows)
    assert block_names.exact_groups(docs(spark, [])).count() == 0
    kept = block_names.deduplicated(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs(spark, []).columns


# ---- ranked search


def ranking(rows, bench, k=10):
    held = [(i, words(t)) for i, t in rows]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    tfs = [Counter(w) for _, w in held]
    out = Counter()
    for item, text in bench:
        scored = []
        for (i, w), tf in zip(held, tfs):
            s = 0
            for x in words(text):
                if x in tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    s += weight * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * (25 + (75 * len(w) * n_docs) // total)))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out.update((item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1))
    return out


def hits(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("heads", "k", "run_bytes"), [(100, 10, 1 << 20), (1, 3, 200), (2, 1, 1000)])
def test_search(spark, monkeypatch, heads, k, run_bytes):
    monkeypatch.setattr(threshold_search, "RUN_BYTES", run_bytes)
    rows = random_rows(3, 150) + [(700 + j, "w4é rare W9é") for j in range(15)]
    bench = [(j, t) for j, (_, t) in enumerate(rows[:12])] + [(50, "w4é rare rare w4é"), (51, None), (52, ""), (53, "nowhere"), (None, rows[1][1]), (0, rows[2][1]), (54, "w1é " * 50)]
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, term int")
    assert hits(threshold_search.search(docs(spark, rows), items, k=k, heads=heads)) == ranking(rows, bench, k)


def test_search_in_blocks_long_and_empty(spark):
    rows = random_rows(4, 40) + [(900, "w1é w4é x " * 200_000)]
    bench = [(j, t) for j, (_, t) in enumerate(rows[:9])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert hits(threshold_search.search(docs(spark, rows), items, pairs=40)) == ranking(rows, bench)
    assert threshold_search.search(docs(spark, []), items).count() == 0
    assert threshold_search.search(docs(spark, rows), items.limit(0)).count() == 0
    assert threshold_search.search(docs(spark, [(1, None)]), items).count() == 0


def test_runs_of_words():
    text = "ab cd  " * 3000 + "e" * 5000 + " f g"
    for size in (64, 1000, 100_000):
        got, parts = [], []
        for lo, _, w, part, again in textbytes.word_runs(pa.array(["a b", text, None, "c"]), size, 1):
            got += [(lo, w.text(k, k + 1)) for k in range(again, len(w.starts))] if part else [(lo + r, w.text(k, k + 1)) for r in range(len(w.rows) - 1) for k in range(w.rows[r], w.rows[r + 1])]
            parts.append(part)
        assert got == [(r, x) for r, t in enumerate(["a b", text, "", "c"]) for x in words(t)]
        assert (max(parts) > 1) == (size < 20_000)


# ---- importance resampling


def drawing(rows, bench, percent=25, least=20, buckets=10_000):
    def features(text):
        w = words(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    code = lambda text: [zlib.crc32(f.encode()) % buckets for f in features(text)]
    s, t = Counter(b for _, x in rows for b in code(x)), Counter(b for _, x in bench for b in code(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    scored = []
    for i, x in rows:
        c = code(x)
        weight = sum(map(gain, c)) // len(c) if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(words(x)), len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return Counter([(i, n, w, s, k if k <= drawn else None) for k, (i, _, n, w, s) in enumerate(able, 1)] + [(i, n, w, s, None) for i, m, n, w, s in scored if m < least])


def drawn(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("buckets", [10_000, 7, 65_536])
def test_resampling(spark, buckets):
    rows = random_rows(5, 120)
    bench = [(k, t) for k, (_, t) in enumerate(random_rows(6, 8, 40, 60))] + [(99, None)]
    target = spark.createDataFrame(bench, "item_id long, text string")
    assert drawn(importance.resampled(docs(spark, rows), target, buckets=buckets)) == drawing(rows, bench, buckets=buckets)


def test_resampling_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(importance, "STREAM_BYTES", 300)
    rows = random_rows(7, 30) + [(900, "a long text " * 20_000 + "x" * 3000 + " end")]
    target = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    assert drawn(importance.resampled(docs(spark, rows), target)) == drawing(rows, [(1, rows[2][1])])
    assert importance.resampled(docs(spark, []), target).count() == 0
    assert drawn(importance.resampled(docs(spark, rows), target.limit(0))) == drawing(rows, [])
    some = importance.resample(docs(spark, rows), target, percent=50)
    assert set(some.columns) == set(docs(spark, []).columns) and some.where("rank is null").count() == 0 and some.count() == 50 * sum(len(words(t)) >= 20 for _, t in rows) // 100


def test_checksums_are_joined():
    rng = np.random.default_rng(1)
    for sizes in ((0, 1, 7, 64), (65, 200, 1, 3), (100_000, 2, 2, 2)):
        a, b = [rng.bytes(5) for _ in sizes], [rng.bytes(n) for n in sizes]
        got = importance.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array(sizes))
        assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("op", [op11, op12, op13])
def test_queries_have_their_columns(spark, tmp_path, op):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = {
        op11: [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")],
        op12: [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")],
        op13: [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    }
    got = op.query(spark, str(tmp_path))
    assert got.dtypes == kinds[op] and got.count() == 1
