"""The corpus operators against brute force, on rows with nulls, copies, ties and clashing columns."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skonto.llm import additive_search, decontamination, licences, op1, op4, op7, packing, quality, sharding, toxicity, training, url_rules, warc
from skonto.llm.components import components
from skonto.llm.jaccard_join import bands_and_rows, jaccard_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, token string, rep long, score double, id long"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "x", 1, 0.5, 3) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def random_texts(seed, n, size=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(k)}" for k in rng.integers(0, vocabulary, rng.integers(1, size))) for _ in range(n)]


def test_decontamination(spark):
    base = random_texts(1, 20, 80)
    bench = [(f"b{k}", t) for k, t in enumerate(base[:8])] + [("short", "alpha beta gamma"), ("one", "Zeta"), ("null", None), ("empty", "!!"), ("copy", base[0])]
    texts = [base[0], "x " + base[1] + " y", " ".join(base[2].split()[:20]) + " rest", "Alpha, BETA gamma!", "zeta zeta", None, "", "only noise here", base[3] * 3, "ALPHA beta gamma " * 300] + base[10:]
    got = op1.judged(docs(spark, texts), spark.createDataFrame(bench, "item_id string, text string"))
    want = {}
    for k, t in enumerate(texts):
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            n = min(13, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        items.add(item)
        want[k] = (len(w), len(hit), len(items), bool(hit) and 20 * len(hit) >= len(w))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == want


def test_decontamination_in_blocks_and_empty(spark):
    texts = random_texts(2, 10, 60)
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts[:5])], "item_id string, text string")
    one = decontamination.contamination(docs(spark, texts), bench)
    many = decontamination.contamination(docs(spark, texts), bench, broadcast_tokens=20)
    key = lambda df: sorted((r.doc_id, r.n_hit, tuple(r.items)) for r in df.collect())
    assert key(one) == key(many)
    assert decontamination.contamination(docs(spark, []), bench).count() == 0
    assert key(decontamination.contamination(docs(spark, ["a", "a"], [7, 7]), bench.limit(0))) == [(7, 0, ()), (7, 0, ())]


def test_licences(spark):
    texts = ["intro\nReleased under the MIT License.\nend", "Licensed under the Apache License, Version 2.0", None, "", "nothing", "released under mit license", "x\n\nThis is free and unencumbered software\nreleased into the public domain.\n\ny"]
    got = {r.doc_id: r for r in licences.licence_scan(docs(spark, texts)).collect()}
    assert [got[k].licence for k in range(7)] == ["MIT", "Apache-2.0", None, None, None, None, "Unlicense"]
    assert got[0].dice == 1.0 and got[2].n_licences == 0 and len(got) == 7
    # inside a line, inside a paragraph over lines, and whole texts with changes
    mit = dict(licences.TEMPLATES[-10:])["MIT"]
    texts = ["Copyright 2020 Foo. Licensed under the MIT License. See LICENSE for more", "x y z\nthis program is\nreleased under\nthe ISC License today", "a b " * 500 + mit.replace("Software", "Program", 4) + " c" * 300]
    got = {r.doc_id: r for r in licences.licence_scan(docs(spark, texts)).collect()}
    assert [got[k].licence for k in range(3)] == ["MIT", "ISC", "MIT"]
    # grants in other words, identifiers, and how long texts begin
    gpl = "Preamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\nThe licenses for most software"
    texts = ["Available under the MIT license", "This file is licensed under the terms of the MIT license", "# SPDX-License-Identifier: Apache-2.0\nimport os", gpl, "SPDX-License-Identifier: GPL-2.0", "available under the table"]
    got = {r.doc_id: r.licence for r in licences.licence_scan(docs(spark, texts)).collect()}
    assert [got[k] for k in range(6)] == ["MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", None]
    # every run of template size against every template
    templates = [("A", "one two three four five six"), ("B", "one two three four five six seven eight nine"), ("C", "zwei drei"), ("D", "ha ha ha ho")]
    rng = np.random.default_rng(3)
    vocabulary = "one two three four five six seven eight nine zwei drei ha ha ha ho".split()
    texts = [" ".join("one two three four five six seven eight nine".split()[:k]) for k in range(1, 10)] + ["zwei drei", "ha ha ha ha ho", "ha " * 9]
    texts += [" ".join(vocabulary[(int(s) + j + (rng.random() < 0.15)) % len(vocabulary)] for j in range(int(n))) for s, n in zip(rng.integers(0, 15, 60), rng.integers(1, 25, 60))]
    pairs = lambda w: Counter(zip(w, w[1:]))
    want = {}
    for k, t in enumerate(texts):
        w = words(t)
        for name, body in templates:
            v = words(body)
            n = min(len(w), len(v))
            dice = max((2 * (pairs(w[i : i + n]) & pairs(v)).total() / (n + len(v) - 2) for i in range(len(w) - n + 1) if n > 1), default=0)
            if dice >= 0.8:
                want[k, name] = round(dice, 9)
    found = licences.licence_hits(docs(spark, texts).select("doc_id", "text"), templates)
    assert {(r.doc_id, r.licence): round(r.dice, 9) for r in found.collect()} == want and len(want) > 30
    assert licences.licence_scan(docs(spark, []), []).count() == 0 and licences.licence_scan(docs(spark, ["a b"], [None])).first().licence is None


def test_url_rules(spark):
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"))
    urls = ["http://A.Example.ORG/es/x?q", "https://example.org/en/12#f", "https://other.org", "http://notexample.org/es/1", None, "no scheme", "http://x.net/es/5", "http://EXAMPLE.org?x"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.filtered(pages, rules).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2] == ("other.org", "", None, got[2][3])
    assert got[3] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[4][:3] == ("", "", None) == got[5][:3] and got[7][:3] == ("example.org", "", None)
    assert len(got) == 8 and url_rules.filtered(pages.limit(0), rules).count() == 0


def brute_jaccard(texts):
    grams = []
    for t in texts:
        w = words(t)
        n = min(5, len(w))
        grams.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    link = defaultdict(set)
    for a in range(len(texts)):
        for b in range(len(texts)):
            if a != b and grams[a] and grams[b] and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                link[a].add(b)
    out = {}
    for a in range(len(texts)):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (min(seen), len(link[a]))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard(spark, block):
    rng = np.random.default_rng(4)
    base, texts = random_texts(3, 12, 120), []
    for t in base:
        w = t.split()
        for changes in (0, 0, 1, 1, 2, 4):
            v = list(w)
            for _ in range(changes):
                v[int(rng.integers(0, len(v)))] = f"z{int(rng.integers(0, 99))}"
            texts.append(" ".join(v))
    texts += ["a", "a", "a b", "", None, None, "A b!"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs(spark, texts), block_texts=block).collect()}
    assert got == brute_jaccard(texts)
    bands, rows = bands_and_rows(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard_join(docs(spark, [])).count() == 0
    got = sorted(map(str, jaccard_join(docs(spark, ["a b", "a b", "a b"], [None, 5, 5])).collect()))
    assert len(got) == 3 and sum("class_id=5, n_links=1" in x for x in got) == 2


def test_components(spark):
    df = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100 and len(got) == 43


def labelled(spark, seed, n, mark):
    texts, y = random_texts(seed, n, 80, 300), []
    rng = np.random.default_rng(seed)
    for k in range(n):
        y.append(int(rng.random() < 0.3))
        if y[-1]:
            texts[k] = mark(texts[k])
    return docs(spark, texts), spark.createDataFrame([(k, v, v) for k, v in enumerate(y)], "doc_id long, toxic int, quality int"), y


@pytest.mark.parametrize("module, query", [(toxicity, op4), (quality, op7)])
def test_classifiers(spark, module, query):
    d, labels, y = labelled(spark, 9, 1200, lambda t: t.replace(" ", " vile idiot scum! ", 4) if module is toxicity else t.replace(" w1", " | W1 !!"))
    got = query.judged(d, labels).collect()
    held = [(r.score, y[r.doc_id]) for r in got if r.held_out]
    good, bad = [s for s, v in held if v], [s for s, v in held if not v]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(got) == 1200 and auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if module is toxicity else 4) == (1 if module is toxicity else 2)) for r in got)
    model = module.train(d, labels, F.lit(True))
    odd = module.scored(docs(spark, ["", None, "a", "word " * 200_000]), model)
    assert odd.count() == 4 and odd.where("score between 0 and 1").count() == 4
    none = module.train(d, labels.limit(0), F.lit(True))
    assert module.scored(d.limit(3), none).count() == 3 and module.scored(d.limit(0), model).count() == 0


def test_logistic_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    p = training.Logistic.fit(x, y, np.ones(4000))(x)
    assert abs(p.mean() - y.mean()) < 0.01 and abs(p[p > 0.7].mean() - y[p > 0.7].mean()) < 0.05


def test_sharding(spark):
    texts = random_texts(5, 400, 60) + ["hot text " * 9] * 300 + [None, "", "ü" * 50, "long " * 20_000]
    d = docs(spark, texts + ["again"], [*range(len(texts)), 3])
    got = sharding.shard(d, shards=8, ranges=16).collect()
    assert len(got) == len(texts) + 1
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, largest = sum(size.values()), max(r.size for r in got)
    assert all(abs(v - total / 8) <= largest + total / 40 for v in size.values())
    assert next(r.size for r in got if r.doc_id == texts.index("ü" * 50)) == 101
    assert sharding.shard(d.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["none", "one", "own"])
def test_sharding_of_hot_texts(spark, ids):
    texts = ["hot text of many rows"] * 3000 + random_texts(6, 2000, 12) + ["twice so often"] * 2
    named = {"none": [None] * len(texts), "one": [7] * len(texts), "own": list(range(len(texts)))}[ids]
    d = spark.createDataFrame(list(zip(named, texts)), "doc_id long, text string")
    got = sharding.shard(d).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(named, texts))
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert set(size) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    # a shard ends within the copies of one text that is not cut
    largest = max(n * (len(t.encode()) + 1) for t, n in Counter(texts[3000:]).items())
    total = sum(size.values())
    assert all(abs(v - total / 8) <= 2 * largest for v in size.values())
    split = {c for c, s in where.items() if len(s) > 1}
    hot = zlib.crc32(texts[0].encode())
    assert split == {hot} and len(where[hot]) <= 3000 * (len(texts[0]) + 1) * 8 / total + 2


def test_additive_search(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:160] = v[99]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0] * 15 + [None], 0), (903, [float("nan")] * 16, 0), (904, [1.0] * 3, 0), (None, v[0].tolist(), 0), (5, v[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    ask = F.expr("id % 20 = 0")
    got, want = defaultdict(list), {}
    for r in additive_search.nearest(df, ask, shortlist=80).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    w = v.astype(np.float64)
    hits = 0
    for q in range(0, 900, 20):
        s = np.array([math.fsum(w[q] * x) for x in w])
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:20].tolist()
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(x - s[i]) < 1e-9 for _, i, x in mine)
        hits += len(set(want) & {i for _, i, _ in mine})
    assert set(got) == set(range(0, 900, 20)) and hits / (45 * 20) > 0.95
    assert {i for _, i, _ in got[100]} == set(range(99, 120)) - {100}
    few = additive_search.nearest(df.where("vec_id < 4"), ask)
    assert few.count() == 3 and additive_search.nearest(df.limit(0), ask).count() == 0
    exact = additive_search.brute_force(df.where("vec_id < 4"), ask)
    assert sorted(r.vec_id for r in exact.collect()) == sorted(r.vec_id for r in few.collect())


def test_additive_search_with_short_lists(spark):
    """The shortlist is 4 % of the vectors, which are doubles that no float holds."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 24)) * 1e6 + rng.normal(size=(3000, 24)) / 3
    df = spark.createDataFrame([(k, x.tolist(), None) for k, x in enumerate(v)], "vec_id long, embedding array<double>, key string")
    ask = F.expr("id % 20 = 0")
    got = additive_search.nearest(df, ask, shortlist=120, block_candidates=1000, block_queries=50, sample=1500)
    true = {(r.query_id, r.vec_id): r.score for r in additive_search.brute_force(df, ask).collect()}
    mine = {(r.query_id, r.vec_id): r.score for r in got.collect()}
    assert len(mine) == len(true) == 150 * 20
    assert len(set(mine) & set(true)) / len(true) >= 0.9
    assert all(mine[k] == true[k] for k in set(mine) & set(true))


@pytest.mark.parametrize("rows", ["close groups", "lengths apart", "far from the origin"])
def test_additive_search_of_rows_that_codes_tell_apart_badly(spark, rows):
    """Neighbours differ by less than any code does; all of them are found, though shortlists are short."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1600, 16))
    if rows == "close groups":
        v = rng.normal(size=(2, 16))[np.arange(1600) % 2] + v * 1e-4
    elif rows == "lengths apart":
        v *= np.exp(3 * rng.normal(size=(1600, 1)))
    else:
        v = 1000 + v
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    ask = F.expr("id % 20 = 0")
    got = additive_search.nearest(df, ask, shortlist=40, block_candidates=800, sample=500)
    true = {(r.query_id, r.rank): (r.vec_id, r.score) for r in additive_search.brute_force(df, ask).collect()}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()} == true


def test_additive_search_by_distance(spark):
    v = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = additive_search.nearest(df, F.expr("id = 7"), wanted=5, measure="distance").orderBy("rank").collect()
    far = ((v - v[7]) ** 2).sum(1)
    assert [r.vec_id for r in got] == [k for k in np.argsort(far).tolist() if k != 7][:5]


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 5000, "x" * 300_000, "<p>a</p>"]
    pages = spark.createDataFrame([(k, f"http://h/{k}\n", h, "z") for k, h in zip((5, 3, 1, 2, 9, 8, None), html)], "page_id long, url string, html string, bundle string")
    folder, index = warc.write_bundles(pages, f"file://{tmp_path}/w", frame_bytes=4096, bundle_bytes=100_000)
    got = {r.page_id: r for r in warc.read_bundles(spark, folder, index).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 1: ("response", None), 2: ("revisit", 1), 9: ("response", None), 8: ("response", None), None: ("revisit", 3)}
    assert got[9].payload_bytes == 10_000 and got[1].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    head, block = warc.fetch(folder, index, 8)[0]
    assert head["WARC-Type"] == "response" and block.endswith(b"x" * 300_000)
    import io

    import zstandard

    for name in (tmp_path / "w").iterdir():
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(name.read_bytes()), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")
    assert {x.name for x in (tmp_path / "w").iterdir()} == {r.bundle for r in index.select("bundle").collect()}
    with pytest.raises(ValueError, match="no file system"):
        warc.opened("dbfs://host/x")
    folder, index = warc.write_bundles(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_bundles(spark, folder, index).count() == 0


def test_packing(spark):
    texts = random_texts(6, 300, 3000) + [None, "", "word " * 10_000]
    got = packing.pack(docs(spark, texts), group_pieces=100).collect()
    whole, used, size = Counter(), Counter(), {}
    places = defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.length
        used[r.bin_id] += r.length
        size[r.bin_id] = r.capacity
        places[r.bin_id].append((r.bin_offset, r.length))
    assert {k: len((t or "").split()) + 1 for k, t in enumerate(texts)} == dict(whole)
    assert all(used[b] <= size[b] for b in used) and all(size[b] == min(c for c in packing.CAPACITIES if c >= used[b]) for b in used)
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
    assert sum(used.values()) / sum(size.values()) > 0.95
    assert packing.pack(docs(spark, [])).count() == 0
    bins, sizes = packing.best_fit([5, 4, 3], (4, 8), {4: 4.5, 8: 8.5})
    assert sizes in ([8, 4], [8, 8]) and len(set(bins)) == 2
