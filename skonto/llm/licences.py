"""Licence scan: runs of words of documents compared with licence templates by the Dice coefficient of their word bigrams.

Text and template are normalised alike: A-Z lower-cased, everything but letters and digits a blank. A template of w words
is compared with every run of w words of a text, wherever it stands; a text of fewer words is one run. Bigrams count as
often as they occur, so a run of n bigrams and a template of m have the coefficient ``2 shared / (n + m)``, where ``shared``
adds for each bigram the smaller of its two counts.

* Size bounds prune templates: a text of n bigrams can reach a coefficient d only for templates with ``m <= n (2 - d) / d``.
* A run that reaches d shares at least ``m d / (2 - d)`` of the template's bigrams, so of any choice of that many less one
  from its m bigrams it lacks at least one at most. The longest bigrams beyond those are the template's anchors: a text
  without any anchor of a template is not similar to it anywhere. Most texts end there, at one look for anchors.
* In what is left, the k-th occurrence of a bigram that a template holds c times counts for the runs that begin after its
  (k-c)-th occurrence and hold it: an interval of beginnings. The sum of these intervals, from left to right, is ``shared``
  of every run, so the scan is linear in the words of a text, not in the runs times the words of a template.

All of it is DataFrame functions. Templates are one literal, expanded by Spark; they are broadcast, so they are bounded
(``MOST_BIGRAMS``), and more of them are an error.

Defined cases: a null or empty text, and one without two words, has no bigrams and no licence; equal coefficients go to the
template with more bigrams, then to the smaller licence id; rows without an id and rows that repeat keep a row each; very
long texts are scanned whole; columns other than the named ones are ignored, whatever they are called; no templates find
nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm.common import materialise
from skonto.llm.licence_texts import TEMPLATES

SIMILARITY = 0.8
#: Most bigrams of all templates together; they go to every task.
MOST_BIGRAMS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = "_licence_row"


def bigrams_of_template(text: str) -> dict[str, int]:
    """How often each word bigram of a template occurs, normalised as texts are."""
    words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
    return dict(Counter(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_shared(m: int, similarity: float) -> int:
    """The fewest bigrams that a run of a size within the bounds shares with a template of ``m``."""
    d = Fraction(similarity).limit_denominator(10_000)
    return max(1, -(-m * d // (2 - d)))


def anchors(bigrams: dict[str, int], similarity: float) -> list[str]:
    """Bigrams of which every similar run holds one: the longest, as long words are rare."""
    m = sum(bigrams.values())
    spare, out = m - least_shared(m, similarity) + 1, []
    for b in sorted(bigrams, key=lambda b: (-len(b), b)):
        if spare <= 0:
            break
        out.append(b)
        spare -= bigrams[b]
    return out


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], similarity: float) -> DataFrame:
    """(template, licence, m, bigram, times, anchor): every bigram of every template of two words or more."""
    rows = []
    for k, (licence, text) in enumerate(sorted(set(templates))):
        found = bigrams_of_template(text)
        if found:
            first = set(anchors(found, similarity))
            rows.append({"t": k, "l": licence, "m": sum(found.values()), "b": [{"b": b, "c": n, "a": b in first} for b, n in sorted(found.items())]})
    if sum(len(r["b"]) for r in rows) > MOST_BIGRAMS:
        raise ValueError(f"the templates hold more than {MOST_BIGRAMS} bigrams")
    schema = "array<struct<t:int,l:string,m:int,b:array<struct<b:string,c:int,a:boolean>>>>"
    held = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    return held.select("t", "l", "m", F.inline("b")).toDF("template", "licence", "m", "bigram", "times", "anchor")


def words_of(text: Column) -> Column:
    """The normalised words of a text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def bigrams_of(words: str) -> Column:
    """The bigrams of a column of words in their order."""
    return F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def licence_hits(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(the columns of ``documents`` but the text, licence, m, dice, first_word): each similar template at its best run.

    ``first_word`` counts from 0; of equally similar runs it is the first.
    """
    spark = documents.sparkSession
    d = Fraction(similarity).limit_denominator(10_000)
    names = [c for c in documents.columns if c != text]
    table = template_table(spark, templates, similarity)
    # A generator is a fence: what it has made is not computed again by the filters above it.
    spoken = documents.where(F.col(text).isNotNull()).select(*names, F.explode(F.array(words_of(F.col(text)))).alias("words")).where(F.size("words") > 1)
    first = sorted({b for _, body in templates for b in anchors(bigrams_of_template(body), similarity)})
    likely = spoken.where(F.exists(bigrams_of("words"), lambda b: b.isin(first)))
    likely = materialise(likely.withColumn(ROW, F.monotonically_increasing_id()), "licence-candidates")

    occurring = likely.select(ROW, (F.size("words") - 1).alias("n"), F.posexplode(bigrams_of("words")).alias("at", "bigram"))
    wide = F.col("n") * (2 * d.denominator - d.numerator) >= F.col("m") * d.numerator
    hits = occurring.join(F.broadcast(table), "bigram").where(wide).select(ROW, "template", "licence", "m", "n", "bigram", "times", "at")
    # from here on everything is grouped within a row, so one exchange serves all groupings
    every = (
        hits.repartition(ROW)
        .groupBy(ROW, "template", "licence", "m", "n", "bigram", "times")
        .agg(F.array_sort(F.collect_list("at")).alias("places"))
        .withColumn("all", F.sum(F.size("places")).over(Window.partitionBy(ROW, "template", "licence", "m", "n")))
        .where(F.col("all") * (2 * d.denominator - d.numerator) >= F.col("m") * d.numerator)
        .withColumn("length", F.least("m", "n"))
    )
    last = F.col("n") - F.col("length")
    spans = F.transform(
        "places",
        lambda p, j: F.struct(
            F.greatest(p - F.col("length") + 1, F.when(j >= F.col("times"), F.get("places", j - F.col("times")) + 1).otherwise(0), F.lit(0)).alias("from"),
            F.least(p, last).alias("to"),
        ),
    )
    key = [ROW, "template", "licence", "m", "length"]
    counted = every.select(*key, F.inline(F.filter(spans, lambda x: x["from"] <= x["to"])))
    steps = counted.select(*key, F.inline(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("step")), F.struct((F.col("to") + 1).alias("at"), F.lit(-1).alias("step")))))
    shared = steps.groupBy(*key, "at").agg(F.sum("step").alias("step")).withColumn("shared", F.sum("step").over(Window.partitionBy(*key).orderBy("at")))
    best = shared.groupBy(*key).agg(F.max("shared").alias("shared"), F.min_by("at", F.struct(-F.col("shared"), "at")).alias("first_word"))
    similar = best.where(2 * d.denominator * F.col("shared") >= d.numerator * (F.col("m") + F.col("length")))
    named = similar.select(ROW, "licence", "m", (2 * F.col("shared") / (F.col("m") + F.col("length"))).alias("dice"), "first_word")
    return likely.select(ROW, *names).join(named, ROW).drop(ROW)


def licence_scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, licence (of the best hit, else null), dice, licences (all, by comma) and their number."""
    body = F.col(text).cast("string")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(body), F.lit(0)).alias("digest"), body.alias("text"))
    hits = (
        licence_hits(docs, templates, "text", similarity)
        .groupBy("doc_id", "digest")
        .agg(
            # structs compare by their fields in order; the smallest is the best
            F.min(F.struct((-F.col("dice")).alias("worse"), (-F.col("m")).alias("less"), "licence")).alias("best"),
            F.array_sort(F.collect_set("licence")).alias("all"),
        )
        .select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "best", "all")
    )
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left").select(
        "doc_id",
        F.col("best.licence").alias("licence"),
        (-F.col("best.worse")).alias("dice"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("licences"),
        F.greatest(F.coalesce(F.size("all"), F.lit(0)), F.lit(0)).cast("long").alias("n_licences"),
    )
