"""Name matching against all pairs, and the evidence of bank lines."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from skonto.operators import bank, names

WORDS = "alpenhof sonnenhotel meyer mueller brandt elektro technik gmbh 3m hp ag bp hotel reinigung waescherei seeblick nord sued 24 kontor".split()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if not (old := row) else [i, *([0] * len(b))]
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def match(a, b):
    if a == b:
        return 1.0
    out = 0.0
    if min(len(a), len(b)) >= 5 and all(2 * sum(c.isalpha() for c in w) > len(w) for w in (a, b)):
        if a.startswith(b) or b.startswith(a):
            out = names.BEGINS
        if (near := 1 - levenshtein(a, b) / max(len(a), len(b))) >= names.NEAR:
            out = max(out, near)
    return out


def brute(left, right, floor):
    """Every pair measured; nothing decides beforehand which pairs meet."""
    every = {n: sorted(set(n.split())) for n in {*left, *right}}
    df = Counter(w for ws in every.values() for w in ws)
    weight = {w: min(12, len(w)) * (1 + math.log1p(len(every) / (1 + n)) / 2) * (0.25 if w in names.GENERIC else 1) * (0.6 if w.isdigit() else 1) for w, n in df.items()}
    out = {}
    for a in set(left):
        for b in set(right):
            x, y = every[a], every[b]
            shares = sorted((sum(weight[t] * max(match(t, u) for u in y) for t in x) / sum(weight[t] for t in x), sum(weight[u] * max(match(t, u) for t in x) for u in y) / sum(weight[u] for u in y)))
            s = 0.3 * shares[0] + 0.7 * shares[1]
            s = min(s, 0.8) if min(len(x), len(y)) == 1 else s
            p, q = a.replace(" ", ""), b.replace(" ", "")
            number = lambda t: "".join(c for c in t if c.isdigit())
            j = 1 - levenshtein(p, q) / max(len(p), len(q)) if number(p) == number(q) else 0
            s = 1.0 if a == b else max(s, j if j >= 0.88 else 0)
            if s >= floor:
                out[a, b] = round(s, 9)
    return out


def agree(spark, printed, known, floor):
    left, right = spark.createDataFrame([(n,) for n in printed], "printed string"), spark.createDataFrame([(n,) for n in known], "known string")
    got = {(r.printed, r.known): round(r.s, 9) for r in names.similar_names(left, right, floor).collect()}
    want = brute(printed, known, floor)
    assert got == want
    return want


def test_similar_names(spark):
    rng = np.random.default_rng(1)
    long = "schneiderberger kaltenbrunn versicherungsmakler grosskuechenbedarf".split()
    known = sorted({" ".join(rng.choice(WORDS + long, int(rng.integers(1, 4)), replace=False)) for _ in range(70)})

    def typos(n):
        for _ in range(int(rng.integers(0, 1 + len(n) // 6))):
            k = int(rng.integers(0, len(n)))
            n = n[:k] + "xqm "[int(rng.integers(0, 4))] * int(rng.integers(0, 2)) + n[k + int(rng.integers(0, 2)) :]
        return n

    printed = sorted({" ".join(typos(n).split()) for n in known} - {""}) + ["hp", "3m", "xeyer elektro", "ganz anders", "schmeiderbergar", "schneiderberger kaltemprunn", "abc def", "kalten brunn", "e1ektro rneyer", "k12345"]
    want = agree(spark, printed, known + ["abcdef", "k12346", "kaltenbrunn"], 0.75)
    assert len(want) > 60 and ("abc def", "abcdef") in want and ("kalten brunn", "kaltenbrunn") in want
    assert any(p == "schmeiderbergar" for p, _ in agree(spark, printed, ["schneiderberger", "schneiderberger kaltenbrunn"], 0.6))
    none = spark.createDataFrame([], "printed string")
    assert names.similar_names(none, spark.createDataFrame([("a",)], "known string"), 0.75).count() == 0


@pytest.mark.parametrize("least", [0.6, 0.75, 0.88])
def test_near_strings(spark, least):
    rng = np.random.default_rng(3)
    strings = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 14)))) for _ in range(250)})
    a, b = strings[::2], strings[1::3] + strings[:20]
    got = {(r.a, r.b): round(r.match, 9) for r in names.near_strings(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), least).collect()}
    close = lambda x, y: 1 - levenshtein(x, y) / max(len(x), len(y))
    assert got == {(x, y): round(close(x, y), 9) for x in a for y in b if x != y and close(x, y) >= least}


def test_evidence(spark):
    lines = spark.createDataFrame(
        [(1, "", "Miete Alpenhof Meyer GmbH Mai", "", -50_000), (2, "3M", "x", "", -1), (3, None, "Az. K-4711/08", None, -7), (4, "Xeyer Brandt", "", "", -3)],
        "tx_id long, counterparty_name string, purpose string, reference string, amount_cents long",
    )
    parties = spark.createDataFrame([(1, None, "Alpenhof Meyer GmbH"), (2, None, "Minnesota"), (3, 1, "Inkasso Nord"), (4, None, "Meyer Brandt")], "party_id long, represents_id long, name string")
    aliases = spark.createDataFrame([(2, "3M")], "party_id long, alias string")
    pairs = lambda df: {(r.tx_id, r.supplier_id) for r in df.collect()}
    assert pairs(bank.name_in_purpose(lines, parties)) == {(1, 1)}
    assert {(2, 2), (4, 4)} <= pairs(bank.name_evidence(lines, parties, aliases))
    refs = spark.createDataFrame([(9, "K-4711/08")], "supplier_id long, value string")
    assert pairs(bank.reference_mentions(lines, refs)) == {(3, 9)}
    recurring = spark.createDataFrame([(1, 5, True), (2, 6, False)], "recurring_id long, supplier_id long, active boolean")
    amounts = spark.createDataFrame([(1, "2024-01-01", 50_000), (1, "2025-01-01", 60_000), (2, "2024-01-01", 50_000)], "recurring_id long, valid_from string, gross_cents long")
    assert pairs(bank.recurring_amounts(lines, recurring, amounts)) == {(1, 5)}


def test_existing_payments(spark):
    lines = spark.createDataFrame([(1, 5, -100, "2024-01-10")], "tx_id long, supplier_id long, amount_cents long, booking_date string")
    paid = spark.createDataFrame([(7, 5, 100, "2024-01-06"), (8, 5, 100, "2024-01-09"), (9, 5, 100, "2024-01-11"), (10, 5, 100, "2024-01-20")], "payment_id long, supplier_id long, payment_cents long, payment_date string")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "payment_id long")
    found = lambda **kw: [r.payment_id for r in bank.existing_payments(lines, paid, **kw).collect()]
    assert found() == [7] and found(linked=ids(7)) == [8] and found(active=ids(9, 10)) == [9] and found(active=ids(10)) == []
