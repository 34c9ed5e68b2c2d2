"""URL filtering by mined association rules.

Given rules judge the URLs that they fit. What they say of those URLs labels them, and FP-growth mines which
combinations of URL tokens go with which verdict; so mined rules carry the given verdicts on to URLs alike, and know nothing
else. Mined rules are pruned by support and confidence, and a rule goes if a part of its tokens says the same with no less
confidence. The others are posted in an inverted index, each under its rarest token; a URL that no given rule fits looks
up its tokens there, verifies the whole combination, and takes the verdict of its best rule: the surest, then the one of
most support, then a block, then the smallest text. URLs are looked up once for each different set of tokens.

Mining stays small on URLs of many segments without losing a rule that pruning would keep:

* a token that only occurs with one verdict is as sure as a rule can be, so it is a rule alone and no combination with it
  can be more; it takes no part in combinations;
* tokens that occur in the same labelled URLs are one: a combination with both is as sure as with either. The class takes
  part once, and a URL has it if it has any of its tokens.

What is left of a URL brings at most ``MOST_TOGETHER`` classes to FP-growth, the surest (ties: the more frequent, then the
smaller text), which bounds the itemsets of a URL by 2 to this number; each class is mined alone all the same. FP-growth
only proposes combinations: each is counted again on the whole token sets of all labelled URLs, so a rule's support and
confidence are those of all URLs, and URLs of up to ``MOST_TOGETHER`` mixed classes give up every combination. Of a URL with
more, combinations are proposed if enough URLs have them among their surest.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens, and the default verdict unless
a rule fits; rows without an id and rows that repeat keep a row each; a token may hold blanks or any other character;
columns other than the named ones are ignored, whatever they are called; without labelled URLs nothing is mined and the
default verdict holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A combination is mined if it is in this share of the labelled URLs, and kept if this share of its URLs agree.
SUPPORT, CONFIDENCE = 0.005, 0.6
#: Most token classes of one labelled URL of which combinations are proposed.
MOST_TOGETHER = 16
#: Equal baskets are made in parts of so many, so that those of a hot URL are spread over tasks.
SAME_BASKETS = 100_000
ALLOW, BLOCK = "allow", "block"
VERDICT = "verdict="


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL: host labels from the right, host suffixes, path words, file type, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")),
    )
    parts = F.filter(F.split(path, "/"), lambda x: x.rlike("[A-Za-z]"))
    words = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.lower(F.regexp_replace(x, "[0-9]+", "0"))))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    return F.array_sort(F.array_distinct(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), words, keys)))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def token_classes(sets: DataFrame, least: int) -> DataFrame:
    """(token, leader, n, blocked, sure) of the tokens that ``least`` URLs of ``sets`` (tokens, verdict, n) have.

    Tokens with the same labelled URLs are a class, led by the smallest. Two sums of independent hashes of their sets stand
    for the URLs, so classes are found in one aggregation, whatever number of URLs a token has.
    """
    marked = sets.withColumn("a", F.xxhash64("tokens", F.lit(1)).cast("decimal(20,0)")).withColumn("b", F.xxhash64("tokens", F.lit(2)).cast("decimal(20,0)"))
    each = marked.select("verdict", "n", "a", "b", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("verdict") == BLOCK, F.col("n")).otherwise(0)).alias("blocked"), F.sum("a").alias("a"), F.sum("b").alias("b")
    ).where(F.col("n") >= least)
    leaders = each.groupBy("n", "a", "b").agg(F.min("token").alias("leader"))
    sure = F.greatest("blocked", F.col("n") - F.col("blocked")) / F.col("n")
    return each.join(leaders, ["n", "a", "b"]).select("token", "leader", "n", "blocked", sure.alias("sure"))


def posting_of(combinations: DataFrame, groups: DataFrame) -> DataFrame:
    """(antecedent, posting) of different combinations: the rarest of their classes, of which ``groups`` has ``n`` each."""
    each = combinations.select("antecedent", F.explode("antecedent").alias("leader")).join(groups.select("leader", "n"), "leader")
    return each.groupBy("antecedent").agg(F.min_by("leader", F.struct("n", "leader")).alias("posting"))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_together: int = MOST_TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Rules and token classes from the columns ``tokens`` and ``verdict`` (of URLs).

    Rules are (antecedent, verdict, confidence, support, posting), where tokens of a class are named by its leader and
    posting is the rarest; classes are (token, leader), of the tokens that rules name.
    """
    sets = materialise(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-token-sets")
    total = sets.agg(F.sum("n").alias("n")).first().n
    least = math.ceil(support * total)
    # no more frequent tokens than tokens of a URL divided by the support
    classes = materialise(token_classes(sets, least), "url-token-classes")
    groups = classes.where("token = leader").select("leader", "n", "blocked", "sure")
    rated = lambda n, of: (F.round(n / of, 9).alias("confidence"), F.round(n / total, 9).alias("support"))
    said = F.array(*[F.struct(F.lit(v).alias("verdict"), n.alias("freq")) for v, n in ((BLOCK, F.col("blocked")), (ALLOW, F.col("n") - F.col("blocked")))])
    alone = groups.select("leader", "n", F.inline(said)).where(F.col("freq") >= least).select(F.array("leader").alias("antecedent"), "verdict", *rated(F.col("freq"), F.col("n")))

    mixed = F.broadcast(classes.where("sure < 1").select("token", "leader", F.struct((-F.col("sure")).alias("s"), (-F.col("n")).alias("m"), F.col("leader").alias("t")).alias("order")))
    kept = sets.select("tokens", "verdict", "n", F.explode("tokens").alias("token")).join(mixed, "token")
    ordered = kept.groupBy("tokens", "verdict", "n").agg(F.array_sort(F.collect_set("order")).alias("all"))
    together = materialise(ordered.select(F.transform("all", lambda x: x["t"]).alias("leaders"), "verdict", "n"), "url-mixed-classes")
    basket = together.select(F.concat(F.slice("leaders", 1, most_together), F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"), "n").where(F.size("items") > 2)
    # FP-growth counts baskets, so a basket comes as often as its URLs do; its least support is of all labelled URLs
    parts = basket.select("items", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SAME_BASKETS))).alias("part")).repartition("items", "part")
    size = F.least(F.lit(SAME_BASKETS), F.col("n") - F.col("part") * SAME_BASKETS)
    baskets = materialise(parts.select("items", F.explode(F.array_repeat(F.lit(0), size.cast("int"))).alias("k")).select("items"), "url-baskets")
    held = baskets.count()
    if held < least:
        raw = alone.limit(0)
    else:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, minConfidence=0.0).fit(baskets)
        proposed = model.freqItemsets.where(F.exists("items", lambda x: x.startswith(VERDICT))).select(
            F.array_sort(F.filter("items", lambda x: ~x.startswith(VERDICT))).alias("antecedent")
        ).where(F.size("antecedent") > 1).distinct()
        posted = posting_of(materialise(proposed, "url-itemsets"), groups)
        held = together.select("leaders", "verdict", F.col("n").alias("k"), F.explode("leaders").alias("posting")).join(posted, "posting")
        whole = held.where(F.size(F.array_except("antecedent", "leaders")) == 0).groupBy("antecedent").agg(
            F.sum("k").alias("n"), F.sum(F.when(F.col("verdict") == BLOCK, F.col("k")).otherwise(0)).alias("blocked")
        )
        raw = whole.select("antecedent", "n", F.inline(said)).where(F.col("freq") >= least).select("antecedent", "verdict", *rated(F.col("freq"), F.col("n")))
    plain = materialise(alone.unionByName(raw).where(F.col("confidence") >= confidence), "url-rules")
    # a rule is redundant if dropping one of its tokens leaves a rule at least as sure
    shorter = plain.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    parts = plain.where(F.size("antecedent") > 1).select(
        "antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("part")
    )
    redundant = (
        parts.join(shorter, "part").where((F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    )
    rules = plain.join(redundant, ["antecedent", "verdict"], "left_anti")
    rarest = posting_of(rules.select("antecedent").distinct(), groups)
    return rules.join(rarest, "antecedent"), classes.select("token", "leader")



def filtered(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
    support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = ALLOW, most_together: int = MOST_TOGETHER,
) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, and the mined antecedent that decided (else null)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    cut = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = cut.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    labelled = judged.where("given is not null").select("tokens", F.col("given.verdict").alias("verdict"))
    open_sets = materialise(judged.where("given is null").select("tokens").distinct(), "url-open-sets")
    if labelled.limit(1).count():
        rules, classes = mined_rules(labelled, support, confidence, most_together)
        rules = materialise(rules, "mined-url-rules")
        named = open_sets.select("tokens", F.explode("tokens").alias("token")).join(classes, "token")
        held = named.groupBy("tokens").agg(F.collect_set("leader").alias("leaders"))
        best = (
            held.select("tokens", "leaders", F.explode("leaders").alias("posting"))
            .join(rules, "posting")
            .where(F.size(F.array_except("antecedent", "leaders")) == 0)
            .groupBy("tokens")
            .agg(
                F.min_by(
                    F.struct("verdict", "antecedent"),
                    F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("verdict") != BLOCK).alias("v"), F.col("antecedent").alias("a")),
                ).alias("mined")
            )
        )
    else:
        best = open_sets.select("tokens", F.lit(None).cast("struct<verdict:string,antecedent:array<string>>").alias("mined")).limit(0)
    # written, so that the rows of a hot token set can be split where they meet its verdict
    best = materialise(best, "url-verdicts")
    # rows that a given rule judges look nothing up: each has a key of its own, so they don't meet in one task
    key = F.when(F.col("given").isNull(), F.col("tokens")).otherwise(F.array(F.lit(""), F.col("page_id").cast("string"), F.xxhash64("url").cast("string")))
    return judged.withColumn("set", key).join(best.withColumnRenamed("tokens", "set"), "set", "left").select(
        "page_id",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined.verdict", F.lit(default)).alias("verdict"),
        F.array_join("mined.antecedent", " ").alias("mined_by"),
    )
