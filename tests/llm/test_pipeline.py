"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as P

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{int(k)}" for k in rng.integers(0, 500, 60))
    rows, labels = [], []
    for k in range(900):
        t, toxic, good = text(), int(k % 5 == 0), int(k % 4 != 0)
        t = t.replace(" ", " vile idiot scum ", 6) if toxic else t
        t = t if good else t.replace(" ", " ### ", 25)
        rows.append((k, t, "en", "s", len(t)))
        labels.append((k, good, toxic))
    bench = [(1, text())]
    rows += [(1000, rows[1][1], "en", "s", 1), (1001, rows[1][1] + " end", "en", "s", 1), (1002, bench[0][1] + " tail", "en", "s", 1), (1003, None, "en", "s", 0), (None, rows[2][1], "en", "s", 1)]
    out = str(tmp_path_factory.mktemp("sf"))
    write(spark, out, rows, labels, bench)
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = docs.cache()
    toxic = {k for k in range(900) if k % 5 == 0}
    assert len(kept["toxicity"] & toxic) <= 20 and len(set(range(900)) - toxic - kept["toxicity"]) <= 10
    bad = {k for k in kept["toxicity"] if k is not None and k < 900 and k % 4 == 0}
    assert len(kept["quality classifier"] & bad) <= 20 and len({k for k in kept["toxicity"] - bad} - kept["quality classifier"]) <= 15
    assert not {1000, 1001} & kept["n-gram Jaccard join"] and 1 in kept["n-gram Jaccard join"] and None in kept["n-gram Jaccard join"]
    assert kept["n-gram Jaccard join"] - kept["benchmark decontamination"] == {1002}
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == kept["benchmark decontamination"]


def test_run_and_empty(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 0
    write(spark, str(tmp_path), [], [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_other_columns_come_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, name in enumerate(("toxic_score", "quality_score", "_row", "row_number", "score", "Row_Number_", "class_id", "id", "digest", "row", "contaminated")):
        docs = docs.withColumn(name, P.F.lit(k) + P.F.coalesce("doc_id", P.F.lit(-1)))
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        assert docs.where(" or ".join(f"`{c}` <> {k} + coalesce(doc_id, -1)" for k, c in enumerate(columns[5:]))).count() == 0
    assert docs.count() > 0 and P.STAGES[-1][1](spark, docs, folder).count() > 0
