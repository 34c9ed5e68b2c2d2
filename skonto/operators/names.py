"""How well two company names agree, over whole tables of names.

A name is its words. A word weighs more the longer it is and the fewer names have it; words that many companies share and
numbers weigh less. Two words agree fully if they are equal, by four fifths if the longer begins with the shorter, and else as far as
their edit distance leaves of them. Of two names the other's words cover a share of the weight each; the larger share counts most, as
one may be short for the other. Names also agree by their letters without blanks if these differ little and
their digits not at all.

Everything is joins, and no pair that the measure accepts is lost:

* Strings within a distance of k edits (``near_strings``): of k + 1 parts of one, the i-th stands unchanged in the other, with
  fewer than i edits before it and no more than k + 1 - i behind it. So each part is looked up at the few places where it can
  stand, in strings of the lengths that k allows; what meets is measured.
* Names by their words: two names can only reach a floor of f if a share of f or more of one is covered; so names meet by
  words of a name that are left when its lightest words below that share are set aside, and a word that many names have
  seldom is among those left.
* Names by their letters: as near strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.sources.shared import written

#: Words of fewer letters, and words of digits for the half or more, only agree if they are equal.
LEAST_LETTERS = 5
BEGINS, NEAR, JOINED, ONE_WORD = 0.8, 0.75, 0.88, 0.8
#: A word weighs as much as its letters, up to so many.
MOST_LETTERS = 12
#: How much the share counts of the name that is covered more; the other's makes up the rest.
COVERED_MORE = 0.7

# Words that many company names share.
GENERIC = frozenset(
    "hotel hotels restaurant gasthaus gasthof service services dienst dienste dienstleistung dienstleistungen technik handel handels grosshandel bau "
    "bauunternehmen gmbh haus haustechnik verwaltung verwaltungs immobilien vertrieb versand logistik transport consulting beratung gruppe group holding "
    "international deutschland german systems solutions center zentrum werk werke the and of limited company corp stadt gemeinde kanzlei praxis firma".split()
)


def words_of_names(names: DataFrame, name: str) -> DataFrame:
    """(name, word) of the different words of different names."""
    return names.select(F.col(name).alias("name")).distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).where("word <> ''")


def word_weights(words: DataFrame) -> DataFrame:
    """(word, weight) from the (name, word) of all names."""
    total = words.select("name").distinct().agg(F.count("*").alias("total"))
    known = words.groupBy("word").agg(F.countDistinct("name").alias("n")).crossJoin(F.broadcast(total))  # one row
    letters = F.least(F.length("word"), F.lit(MOST_LETTERS)).cast("double")
    rare = 1 + F.log1p(F.col("total") / (1 + F.col("n"))) / 2
    less = F.when(F.col("word").isin(*sorted(GENERIC)), 0.25).otherwise(1.0) * F.when(F.col("word").rlike("^[0-9]+$"), 0.6).otherwise(1.0)
    return known.select("word", (letters * rare * less).alias("weight"))


def _closeness(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def near_strings(left: DataFrame, right: DataFrame, least: float, *same: str) -> DataFrame:
    """(a, b, match) of the different strings ``a`` of ``left`` and ``b`` of ``right`` with a closeness of ``least`` (over a half) or more.

    Columns named in ``same`` must be equal on both sides.
    """
    share = F.lit(1 - least)
    edits = lambda n: F.floor(n * share + 1e-9).cast("int")  # noqa: E731  of a string of n letters and one no longer
    begin = lambda n, i, parts: F.floor(n * (i - 1) / parts).cast("int")  # noqa: E731  of its i-th part, from 0

    def parts_of(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        sized = df.select(c, *same, n.alias("long"), edits(n).alias("k"))
        cut = F.transform(F.sequence(F.lit(1), F.col("k") + 1), lambda i: F.struct(i.alias("i"), F.substr(F.col(c), begin(F.col("long"), i, F.col("k") + 1) + 1, begin(F.col("long"), i + 1, F.col("k") + 1) - begin(F.col("long"), i, F.col("k") + 1)).alias("part"), begin(F.col("long"), i, F.col("k") + 1).alias("at")))
        return sized.select(c, *same, "long", F.inline(cut))

    def places_of(df: DataFrame, c: str) -> DataFrame:
        """Where parts of strings as long or longer may stand in shorter ones."""
        n = F.length(c)
        sized = df.select(c, *same, n.alias("n"), F.explode(F.sequence(n, F.floor(n / (1 - share) + 1e-6).cast("int"))).alias("long")).withColumn("k", edits(F.col("long"))).where("long - n <= k")
        each = sized.select(c, *same, "n", "long", "k", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("i"))
        at, size, off = begin(F.col("long"), F.col("i"), F.col("k") + 1), begin(F.col("long"), F.col("i") + 1, F.col("k") + 1) - begin(F.col("long"), F.col("i"), F.col("k") + 1), F.col("n") - F.col("long")
        low = F.greatest(F.lit(0), at - (F.col("i") - 1), at + off - (F.col("k") + 1 - F.col("i")))
        high = F.least(F.col("n") - size, at + (F.col("i") - 1), at + off + (F.col("k") + 1 - F.col("i")))
        found = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.substr(F.col(c), p + 1, size)))
        return each.select(c, *same, "long", "i", F.explode(F.array_distinct(found)).alias("part"))

    a, b = left.select("a", *same).where("a <> ''").distinct(), right.select("b", *same).where("b <> ''").distinct()
    by = ["long", "i", "part", *same]
    met = parts_of(a, "a").join(places_of(b, "b"), by).select("a", "b").unionByName(parts_of(b, "b").join(places_of(a, "a"), by).select("a", "b"))
    return met.where("a <> b").distinct().withColumn("match", _closeness(F.col("a"), F.col("b"))).where(F.col("match") >= least)


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, match) of the words of two (word) tables that agree at all."""
    a, b = left.select(F.col("word").alias("a")).distinct(), right.select(F.col("word").alias("b")).distinct()
    plain = lambda x, c: x.where((2 * F.length(F.regexp_replace(c, "[0-9]", "")) > F.length(c)) & (F.length(c) >= LEAST_LETTERS))
    a_plain, b_plain = plain(a, "a"), plain(b, "b")
    beginnings = lambda df, c: df.where(F.length(c) > LEAST_LETTERS).select(c, F.explode(F.transform(F.sequence(F.lit(LEAST_LETTERS), F.length(c) - 1), lambda n: F.substr(F.col(c), F.lit(1), n))).alias("key"))
    equal = a.join(b, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("match"))
    begins = beginnings(a_plain, "a").join(b_plain, F.col("key") == F.col("b")).select("a", "b").unionByName(beginnings(b_plain, "b").join(a_plain, F.col("key") == F.col("a")).select("a", "b"))
    return equal.unionByName(begins.withColumn("match", F.lit(BEGINS))).unionByName(near_strings(a_plain, b_plain, NEAR)).groupBy("a", "b").agg(F.max("match").alias("match"))


def _heavy(words: DataFrame, floor: float) -> DataFrame:
    """The words of each name without its lightest, which together weigh less than the share that must be covered."""
    light = F.sum("weight").over(Window.partitionBy("name").orderBy("weight", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return words.withColumn("light", light).where(F.col("light") >= floor * F.col("total") - 1e-9).select("name", "word")


def similar_names(left: DataFrame, right: DataFrame, floor: float, left_name: str = "printed", right_name: str = "known") -> DataFrame:
    """(left name, right name, s) of all pairs of different normalised names that agree by ``floor`` (above 0.5) or more."""
    one, two = (written(words_of_names(x, c), "name-words") for x, c in ((left, left_name), (right, right_name)))
    weights = word_weights(one.unionByName(two).distinct())
    whole = F.sum("weight").over(Window.partitionBy("name"))
    one, two = (written(x.join(weights, "word").withColumn("total", whole).withColumn("n", F.count("*").over(Window.partitionBy("name"))), "weighted-words") for x in (one, two))
    pairs = written(word_pairs(one, two), "word-pairs")
    by = lambda x, y: x.select(F.col("name").alias("l"), F.col("word").alias("a")).join(pairs, "a").join(y.select(F.col("name").alias("r"), F.col("word").alias("b")), "b").select("l", "r")
    letters = lambda x, c: x.select("name").distinct().select("name", F.replace("name", F.lit(" "), F.lit("")).alias(c), F.regexp_replace("name", "[^0-9]", "").alias("digits"))
    left_letters, right_letters = letters(one, "a"), letters(two, "b")
    alike = near_strings(left_letters, right_letters, JOINED, "digits").select("a", "b").unionByName(left_letters.join(right_letters, F.col("a") == F.col("b")).select("a", "b")).distinct()
    by_letters = alike.join(left_letters.select("a", F.col("name").alias("l")), "a").join(right_letters.select("b", F.col("name").alias("r")), "b").select("l", "r")
    met = written(by(_heavy(one, floor), two).unionByName(by(one, _heavy(two, floor))).unionByName(by_letters).distinct(), "names-met")
    lw = one.select(F.col("name").alias("l"), F.col("word").alias("a"), F.col("weight").alias("wa"))
    rw = two.select(F.col("name").alias("r"), F.col("word").alias("b"), F.col("weight").alias("wb"))
    each = written(met.join(lw, "l").join(pairs, "a").join(rw, ["r", "b"]), "name-word-pairs")
    from_left = each.groupBy("l", "r", "a", "wa").agg(F.max("match").alias("m")).groupBy("l", "r").agg(F.sum(F.col("wa") * F.col("m")).alias("ca"))
    from_right = each.groupBy("l", "r", "b", "wb").agg(F.max("match").alias("m")).groupBy("l", "r").agg(F.sum(F.col("wb") * F.col("m")).alias("cb"))
    sizes = lambda x, name, total, n: x.groupBy(F.col("name").alias(name)).agg(F.first("total").alias(total), F.first("n").alias(n))
    rows = met.join(from_left, ["l", "r"], "left").join(from_right, ["l", "r"], "left").join(sizes(one, "l", "la", "na"), "l").join(sizes(two, "r", "lb", "nb"), "r")
    a, b = F.col("ca") / F.col("la"), F.col("cb") / F.col("lb")
    covered = F.coalesce(COVERED_MORE * F.greatest(a, b) + (1 - COVERED_MORE) * F.least(a, b), F.lit(0.0))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    joined = F.when(digits("l") == digits("r"), _closeness(F.replace("l", F.lit(" "), F.lit("")), F.replace("r", F.lit(" "), F.lit("")))).otherwise(0.0)
    score = F.when(F.col("l") == F.col("r"), 1.0).otherwise(
        F.greatest(F.when(F.least("na", "nb") == 1, F.least(covered, F.lit(ONE_WORD))).otherwise(covered), F.when(joined >= JOINED, joined).otherwise(0.0))
    )
    return rows.select(F.col("l").alias(left_name), F.col("r").alias(right_name), score.alias("s")).where(F.col("s") >= floor)
