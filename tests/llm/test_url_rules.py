"""The URL filter against brute force over all token combinations, and on URLs that are long, hot or odd."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skonto.llm import url_rules

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/"), ("allow", "com", "/fr/"))


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "s") for k, u in enumerate(urls)], "page_id long, url string, host string, tokens string")


def brute(rows, support, confidence):
    """The verdict of every open URL: the best of all combinations of its tokens."""
    labelled = [(frozenset(r.tokens), r.verdict) for r in rows if r.verdict]
    least = math.ceil(support * len(labelled))
    whole, told = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                whole[c] += 1
                told[c, verdict] += 1
    rules = [(c, v, n / whole[c], n / len(labelled)) for (c, v), n in told.items() if n >= least and round(n / whole[c], 9) >= confidence]
    out = {}
    for r in rows:
        if not r.verdict:
            fit = [(-round(p, 9), -round(s, 9), v != "block") for c, v, p, s in rules if set(c) <= set(r.tokens)]
            out[r.page_id] = "allow" if not fit else ("allow" if min(fit)[2] else "block")
    return out


@pytest.mark.parametrize("support, confidence", [(0.02, 0.6), (0.1, 0.9), (0.3, 0.5)])
def test_mined_rules(spark, support, confidence):
    rng = np.random.default_rng(5)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    urls = [
        f"http://{pick('www.', 'm.', '')}{pick('example', 'other', 'third')}.{pick('org', 'com', 'net')}/{pick('es', 'en', 'de', 'fr')}/{pick('1', '2', 'a b', 'news')}"
        + pick("", "/x", "/x/y") + pick("", "?k=1", "?k=1&l=2") for _ in range(600)
    ]
    df = pages(spark, urls)
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    rows = df.select("page_id", url_rules.tokens_of(F.col("url"), host, path).alias("tokens"), url_rules.given_rule(host, path, RULES)["verdict"].alias("verdict")).collect()
    want = brute(rows, support, confidence)
    got = url_rules.filtered(df, RULES, support=support, confidence=confidence).collect()
    assert len(got) == 600 and {r.page_id: r.verdict for r in got if r.rule is None} == want
    assert len(set(want.values())) == 2 or support > 0.02


@pytest.mark.parametrize("support, confidence", [(0.02, 0.6), (0.05, 0.75), (0.1, 0.5)])
def test_urls_of_many_mixed_classes(spark, support, confidence):
    """Fourteen path words that each URL has or lacks on its own, so none of them is a class with another."""
    rng = np.random.default_rng(8)
    urls = []
    for _ in range(400):
        path = "/".join(f"t{'abcdefghijklmn'[k]}" for k in range(14) if rng.random() < 0.75)
        urls.append(f"http://example.org/{('es', 'en')[int(rng.integers(0, 2))]}/{path}")
    urls += [f"http://q.net/{'/'.join(f't{c}' for c in 'abcdefghijklmn' if rng.random() < 0.3)}" for _ in range(200)]
    df = pages(spark, urls)
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    rows = df.select("page_id", url_rules.tokens_of(F.col("url"), host, path).alias("tokens"), url_rules.given_rule(host, path, RULES)["verdict"].alias("verdict")).collect()
    assert max(len(r.tokens) for r in rows) > 14
    short = [r.asDict() | {"tokens": [t for t in r.tokens if t.startswith("path:t") or t in ("path:es", "path:en")]} for r in rows]  # the host's tokens are all URLs'
    from types import SimpleNamespace

    want = brute([SimpleNamespace(**r) for r in short], support, confidence)
    got = url_rules.filtered(df, RULES, support=support, confidence=confidence).collect()
    assert {r.page_id: r.verdict for r in got if r.rule is None} == want


def test_cut_urls_give_true_confidences(spark):
    """With combinations proposed from two classes a URL, what is mined has the counts of all URLs."""
    rng = np.random.default_rng(9)
    sets = [(sorted(f"t{k}" for k in range(6) if rng.random() < 0.6), ("block", "allow")[int(rng.random() < 0.4)]) for _ in range(300)]
    rules, classes = url_rules.mined_rules(spark.createDataFrame(sets, "tokens array<string>, verdict string"), 0.02, 0.5, most_together=2)
    found = rules.collect()
    assert any(len(r.antecedent) > 1 for r in found) and all(r.token == r.leader for r in classes.collect())
    for r in found:
        hit = [v for t, v in sets if set(r.antecedent) <= set(t)]
        assert (r.confidence, r.support) == (round(hit.count(r.verdict) / len(hit), 9), round(hit.count(r.verdict) / len(sets), 9))


def test_blanks_long_hot_and_null(spark):
    long = "http://example.org/es/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    mixed = "http://example.org/en/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    urls = ["http://z.net/a path:b", "http://z.net/a/b"] * 3 + [long] * 50 + [mixed] * 50 + ["http://other.net/es/sa"] + [None, "", "://", "x" * 20_000, "http://z.net/" + "a/" * 20_000]
    got = url_rules.filtered(pages(spark, urls), RULES).collect()
    assert len(got) == len(urls) and sorted(r.page_id for r in got) == list(range(len(urls)))
    assert {r.verdict for r in got if r.page_id >= len(urls) - 5} <= {"allow", "block"}
    assert next(r for r in got if r.page_id == 106).verdict == "block"  # path:es was only seen blocked
