"""Rows that share an id, or have none, with different texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from skonto.llm.jaccard_join import jaccard_join

rng = np.random.default_rng(11)
A, B, C, D, BENCH = (" ".join(f"w{int(k)}" for k in rng.integers(0, 500, 60)) for _ in range(5))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_contaminated_beside_clean(spark, folder):
    clean = [(None, A), (None, None), (5, B), (6, C)]
    bad = [(None, BENCH), (None, BENCH + " tail"), (5, BENCH + " end"), (7, BENCH)]
    assert rows(P.drop_contaminated(spark, docs(spark, clean + bad), folder)) == Counter(clean)


def test_copies_of_shared_ids(spark, folder):
    kept = [(5, A), (5, B), (3, C), (8, None), (8, ""), (None, A), (None, A)]
    copies = [(5, A), (6, A), (7, B + " end"), (5, C + " end"), (8, None), (8, "")]
    assert rows(P.drop_copies(spark, docs(spark, kept + copies), folder)) == Counter(kept)


@pytest.mark.parametrize("block", [2048, 1])
def test_classes_of_shared_ids(spark, block):
    given = [(5, A), (5, B), (6, A + " end"), (7, B + " end"), (7, C), (9, C + " end"), (5, D)]
    got = Counter(map(tuple, jaccard_join(docs(spark, given), block_texts=block).collect()))
    assert got == Counter([(5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 5, 1), (7, 7, 1), (9, 7, 1), (5, 5, 0)])
