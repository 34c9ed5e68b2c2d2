"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage takes all documents that its predecessor kept, with all their columns. Toxicity and quality models learn from
the labels of documents that are still there and not held out by the operators' own rule.

Defined cases: a document without text is scored like an empty one and is no copy of anything; documents without an id
are each kept by the stage on copies; of rows that repeat an id with its text one stays there; rows that share an id,
or have none, but differ in their texts are documents of their own; an empty table passes all stages; other columns come
through as they are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto.llm import op1, op4, op7, quality, toxicity
from skonto.llm.common import materialise, table
from skonto.llm.jaccard_join import jaccard_join
from skonto.llm.packing import pack

#: A document that is likelier of low quality than not goes. Without labels of both kinds nothing goes.
LEAST_QUALITY = 0.5


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one that begins so, which no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, because ids may be null and may repeat; and the number's column."""
    row = unused(docs, "row_number")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), label), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~F.expr(op4.HELD_OUT))
    if model.calibration is None:
        return docs
    score = unused(docs, "toxic_score")
    return toxicity.scored(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't call low quality."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~F.expr(op7.HELD_OUT))
    if not model.tables:
        return docs
    score = unused(docs, "quality_score")
    return quality.scored(docs, model, score=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each class of similar documents."""
    docs, row = numbered(docs, "numbered-for-copies")
    key = F.col("doc_id").cast("long")
    named = docs.where(key.isNotNull())
    texts = named.select(F.col(row).alias("row"), key.alias("id"), "text")
    classes = materialise(jaccard_join(texts, "row"), "copy-classes").select(F.col("doc_id").alias("row"), "class_id")
    ids = texts.select("row", "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = ids.join(classes, "row").groupBy("class_id").agg(F.min(F.struct("id", "digest", "row")).alias("first")).select("first.*")
    # texts without words are classes of their own; an id that repeats with such a text stays once
    kept = first.groupBy("id", "digest").agg(F.min("row").alias("row")).select(F.col("row").alias(row))
    return named.join(kept, row, "left_semi").drop(row).unionByName(docs.where(key.isNull()).drop(row))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages."""
    docs, row = numbered(docs, "numbered-for-benchmark")
    judged = op1.judged(docs.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias(row))
    return docs.join(bad, row, "left_anti").drop(row)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the bin that each is packed into."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Stages 1, 2 and 5 can't be said in SQL (trained models, sequential packing).
ORACLE_SQL = None
