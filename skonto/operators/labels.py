"""Labels in texts, found by joins: stretches of words against a table of labels.

A text is its lines, a line its words; wide gaps and bars between cells, colons and number signs are words of their own. Every
stretch of up to four words, written small and without blanks, hyphens and dots, is looked up in the table of labels, so
``Kunden-Nr.``, ``Kunden nr`` and ``Kundennr.`` are one label, and a blank that a scanner puts into a compound changes nothing. Of
labels that overlap the first and longest counts; a label right behind another is the beginning of its value. A value ends
where the next label of its line begins.

The table of labels is fixed and small, so it goes to every task; texts stay where they are and only what was found moves.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.functions.text import normalize_reference
from skonto.operators import document_rules as R
from skonto.operators import label_words as W
from skonto.sources.shared import written

MOST_WORDS = 4
GAP = "¦"
# Words before a label that is alone on its line, words that end a value, and what court files, grouped digits and
# reference numbers look like.
BEFORE = ("ihre", "ihr", "unsere", "unser", "die", "der", "das", "your", "our")
STOPS = ("vom", "from", "dated", "bei", "und", "and", "für", "zum", "zur", "per", "-", "–")
LONGEST_VALUE = 60
COURT = r"\d{1,3} ?[A-Za-zÄÖÜ]{1,3} ?\d{1,5}/\d{2,4}(?![\w/])"
GROUPED = r"\d{1,9}(?: \d{1,4}){1,3}(?![\w.,/\-])"
NUMBER = r"(?:(?!(?:vom|von|am|bis|ab|per|nr|no|an)\b)[A-Za-zÄÖÜäöü]{1,4}[ \-/]?)?\d[\w\-/.]*|(?=[\w\-/.]*\d)[A-Za-zÄÖÜäöü][\w\-/.]*"


def squeezed(words: Column) -> Column:
    """Letters only, written small."""
    return F.regexp_replace(F.lower(words), r"[^\p{L}]", "")


def lines_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, line, next): lines that are not blank with gaps marked, and the line after each.

    A null or empty text has no lines.
    """
    raw = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\r?\n")
    marked = F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\t+| {2,}|\s[·|•‧]\s", f" {GAP} ")), r"\s*([:#])(?=\s|$|\d)", " $1 "), r"(?i)(?<=nr\.|no\.|nummer|number)(?=\d)", " ")))
    kept = F.filter(F.transform(marked, lambda x: F.regexp_replace(x, rf"^(?:{GAP}\s*)+|(?:\s*{GAP})+$", "")), lambda x: x != "")
    once = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(kept)).alias("lines"))  # cut once, whatever is asked of it
    after = F.slice(F.concat("lines", F.array(F.lit(""))), F.lit(2), F.greatest(F.lit(1), F.size("lines")))
    rows = once.select("doc_id", F.posexplode(F.arrays_zip("lines", after.alias("next"))).alias("pos", "x"))
    return rows.select("doc_id", "pos", F.col("x")["lines"].alias("line"), F.col("x")["next"].alias("next")).where("line is not null")


def label_keys(labels: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(key, name) of every label as stretches are written."""
    return sorted({(re.sub(r"[\W\d_]", "", x.lower()), name) for name, forms in labels.items() for x in forms})


def label_table(spark: SparkSession, keys: list[tuple[str, str]]) -> DataFrame:
    """The labels as a table of one literal."""
    rows = json.dumps([{"key": k, "name": n} for k, n in keys])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<key:string,name:string>>")))


def label_hits(lines: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, pos, line, next, words, at, upto, name): labels in lines as spans of words; ``upto`` is the word after the last.

    Stretches that are no label are dropped where the line is, before anything is a row of its own.
    """
    words = F.split("line", r"\s+")
    small = F.transform("words", lambda x: F.when(x.rlike(rf"\d|[:#{GAP}]"), "0").otherwise(squeezed(x)))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("small") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size("small") - i)), lambda n: F.struct(i.alias("at"), (i + n).alias("upto"), F.array_join(F.slice("small", i + 1, n), "").alias("key")))))
    fit = F.filter(spans, lambda s: s["key"].isin(*sorted({k for k, _ in keys})) & (F.get("small", s["at"]) != "") & (F.get("small", s["upto"] - 1) != ""))
    cut = lines.select("doc_id", "pos", "line", "next", F.explode(F.array(words)).alias("words")).select("*", F.explode(F.array(small)).alias("small"))
    found = cut.select("doc_id", "pos", "line", "next", "words", F.explode(F.array(fit)).alias("hits")).where("size(hits) > 0")
    return found.select("doc_id", "pos", "line", "next", "words", F.inline("hits")).join(F.broadcast(label_table(lines.sparkSession, keys)), "key").drop("key")


def without_overlaps(hits: DataFrame) -> DataFrame:
    """Of labels that overlap in a line the first and longest; none that begins where another has just ended."""
    line = Window.partitionBy("doc_id", "pos")
    longest = hits.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "pos", "at").orderBy(F.desc("upto"), "name"))).where("k = 1").drop("k")
    reach = F.max("upto").over(line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    after_colons = F.exists(F.slice("words", F.col("reach") + 1, F.greatest(F.lit(0), F.col("at") - F.col("reach"))), lambda w: ~w.isin(":", "#", ".", "-"))
    return longest.withColumn("reach", reach).where(F.col("reach").isNull() | ((F.col("at") > F.col("reach")) & after_colons)).drop("reach")


def with_rest(spans: DataFrame) -> DataFrame:
    """``spans`` with ``rest``, what may be a value among the words ``tail``: without what leads to it, up to a gap or a word that ends it.

    Each step is a generator, behind which filters can't reach, so nothing is worked out twice.
    """
    once = lambda df, c, name: df.select("*", F.explode(F.array(c)).alias(name))
    place = lambda words, cond: F.array_min(F.filter(F.transform(words, lambda w, i: F.when(cond(w, i), i)), lambda i: i.isNotNull()))
    rows = once(spans, place("tail", lambda w, i: ~w.isin(":", "#", ".", "-", GAP)), "skip")
    rows = once(rows, F.when(F.col("skip").isNotNull(), F.slice("tail", F.col("skip") + 1, F.size("tail"))), "begun")
    # "beim Gläubiger : 4711": words without a digit up to a colon belong to the label
    rows = once(rows, F.coalesce(F.array_position("begun", ":"), F.lit(0)).cast("int"), "colon")
    leads = F.col("colon").between(2, 5) & ~F.exists(F.slice("begun", F.lit(1), F.greatest(F.col("colon") - 1, F.lit(0))), lambda w: w.rlike(rf"\d|{GAP}"))
    rows = once(rows, F.when(leads, F.slice("begun", F.col("colon") + 1, F.size("begun"))).otherwise(F.col("begun")), "said")
    rows = once(rows, place("said", lambda w, i: (i > 0) & ((w == GAP) | F.lower(w).isin(*STOPS) | w.rlike(r"^\(|;$"))), "end")
    return once(rows, F.array_join(F.slice("said", F.lit(1), F.coalesce("end", F.size("said"))), " "), "rest").drop("skip", "begun", "colon", "said", "end")


def with_reference_value(rows: DataFrame) -> DataFrame:
    """``rows`` with ``value``, the reference number in ``rest``; null without one, and for a date or an amount."""
    tidy = rows.select(*[c for c in rows.columns if c != "rest"], F.explode(F.array(F.trim(F.regexp_replace("rest", r"^[\s:#.\-]+|[\s.:;,]+$", "")))).alias("rest")).where((F.col("rest") != "") & (F.length("rest") <= LONGEST_VALUE))
    court = F.nullif(F.regexp_extract("rest", rf"^.{{0,3}}?(?<!\w)({COURT})", 1), F.lit(""))
    plain = F.regexp_extract("rest", rf"(?U)(?<![\w,.])({GROUPED}|{NUMBER})", 1)
    cut = tidy.select("*", F.explode(F.array(F.regexp_replace(F.coalesce(court, plain), r"[.,;:\-/]+$", ""))).alias("value"))
    wrong = F.col("rest").rlike(rf"^(?:{R.AMOUNT})(?![\w/\-])") | F.col("value").rlike(rf"\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}|^(?:{R.AMOUNT})$")
    return cut.where(F.col("value").rlike(r"\d") & (F.length("value") <= 32) & ~wrong)


def labelled_values(documents: DataFrame, labels: list[tuple[str, str]], ends: list[tuple[str, str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, at, name, rest, how): what stands behind or below each label.

    ``labels`` are (key, name) as of ``label_keys``; values end at them and at the labels of ``ends`` too.
    """
    lines = lines_of(documents, doc_id, text)
    hits = written(without_overlaps(label_hits(lines, sorted({*labels, *ends}))), "label-hits")
    line = Window.partitionBy("doc_id", "pos").orderBy("at")
    limit = F.coalesce(F.lead("at").over(line), F.size("words"))
    alone = (F.count("*").over(Window.partitionBy("doc_id", "pos")) == 1) & ~F.exists(F.slice("words", F.lit(1), F.col("at")), lambda w: ~F.lower(w).isin(*BEFORE))
    spans = with_rest(hits.withColumns({"tail": F.slice("words", F.col("upto") + 1, limit - F.col("upto")), "alone": alone}).where(F.col("name").isin(*sorted({n for _, n in labels}))))
    behind = spans.where("rest <> ''").select("doc_id", "pos", "at", "name", "rest", F.lit("line").alias("how"))
    # a label alone on its line: the first cell of the next line, unless that is a label itself
    cell = F.trim(F.substring_index("next", GAP, 1))
    below = spans.where("alone and coalesce(rest, '') = ''").select("doc_id", (F.col("pos") + 1).alias("pos"), "at", "name", cell.alias("rest"))
    below = below.where("rest <> ''").join(hits.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti").select("doc_id", "pos", "at", "name", "rest", F.lit("below").alias("how"))
    # a row of labels over a row of values
    cells = lambda c: F.transform(F.split(c, GAP), lambda x: F.trim(x))
    rows = lines.where(F.col("line").contains(GAP) & ~F.col("line").rlike(r"\d") & F.col("next").rlike(r"\d")).select("doc_id", "pos", cells("line").alias("a"), cells("next").alias("b"))
    rows = rows.where("size(a) = size(b)").select("doc_id", "pos", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x"))
    before = "|".join(BEFORE)
    header = rows.withColumn("key", squeezed(F.regexp_replace(F.lower(F.col("x")["a"]), rf"^(?:{before})\s+", ""))).join(F.broadcast(label_table(documents.sparkSession, labels)), "key")
    return behind.unionByName(below).unionByName(header.select("doc_id", (F.col("pos") + 1).alias("pos"), "at", "name", F.col("x")["b"].alias("rest"), F.lit("header").alias("how")))


def references(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, ref_type, value, normalized): labelled reference numbers, each once, as they are first written.

    ``extra`` adds words to a type's labels. Texts that repeat an id count as one.
    """
    own = {k: (*v, *(extra or {}).get(k, ())) for k, v in W.REFERENCES.items()}
    found = labelled_values(documents, label_keys(own), label_keys(W.ENDS), doc_id, text)
    named = with_reference_value(found).withColumn("normalized", normalize_reference(F.col("value"))).where("length(normalized) >= 3")
    return named.groupBy(F.col("doc_id").alias(doc_id), F.col("name").alias("ref_type"), "normalized").agg(F.min_by("value", F.struct("pos", "at")).alias("value"))
