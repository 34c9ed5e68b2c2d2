"""Base rates as of a day, and interest for late payment by segments of constant rate and principal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.sources.shared import written

FIRST, LAST = "0001-01-01", "9999-12-31"


def validity(rates: DataFrame) -> DataFrame:
    """Rates with [valid_from, valid_to); the first holds for all days before it as well. A rate table has few rows."""
    by_day = Window.partitionBy(F.lit(1)).orderBy("valid_from")
    return rates.select(
        F.when(F.row_number().over(by_day) == 1, F.lit(FIRST).cast("date")).otherwise(F.col("valid_from")).alias("valid_from"),
        F.coalesce(F.lead("valid_from").over(by_day), F.lit(LAST).cast("date")).alias("valid_to"),
        "rate_bp",
    )


def with_rate(rows: DataFrame, day: str, rates: DataFrame) -> DataFrame:
    """Rows with the base rate of their day."""
    r = F.broadcast(validity(rates))
    return rows.join(r, (F.col(day) >= r.valid_from) & (F.col(day) < r.valid_to), "left").drop("valid_from", "valid_to")


def interest_segments(claims: DataFrame, payments: DataFrame, rates: DataFrame, margin_bp: int) -> DataFrame:
    """Segments of each claim: claim_id, day_from, days, principal_cents, rate_bp.

    ``claims``: claim_id, principal_cents, due_date, until; ``payments``: claim_id, payment_date, paid_cents. Every day after
    the due date bears interest on the principal less payments of earlier days.
    """
    inside = (F.col("day") > F.col("due_date")) & (F.col("day") <= F.col("until"))
    # written, because what makes claims would be sorted in one task again for each use of them
    base = written(claims.select("claim_id", "principal_cents", "due_date", "until"), "claims")
    starts = base.select("*", F.date_add("due_date", 1).alias("day"), F.lit(0).cast("bigint").alias("paid"))
    paid = payments.groupBy("claim_id", "payment_date").agg(F.sum("paid_cents").alias("paid"))
    # what was paid up to the due date counts from the first day on
    after = base.join(paid, "claim_id").select(
        "claim_id", "principal_cents", "due_date", "until", F.greatest(F.date_add("payment_date", 1), F.date_add("due_date", 1)).alias("day"), "paid"
    )
    changes = base.join(F.broadcast(rates.select("valid_from")), (F.col("valid_from") > F.col("due_date")) & (F.col("valid_from") <= F.col("until"))).select(
        "claim_id", "principal_cents", "due_date", "until", F.col("valid_from").alias("day"), F.lit(0).cast("bigint").alias("paid")
    )
    after = written(after.where(inside), "payments-of-claims")
    points = starts.unionByName(after).unionByName(changes).where(inside).groupBy("claim_id", "principal_cents", "due_date", "until", "day").agg(F.sum("paid").alias("paid"))
    line = Window.partitionBy("claim_id").orderBy("day")
    rest = F.greatest(F.lit(0).cast("bigint"), F.col("principal_cents") - F.sum("paid").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.coalesce(F.lead("day").over(line), F.date_add("until", 1))
    cut = points.select("claim_id", F.col("day").alias("day_from"), F.datediff(end, "day").alias("days"), rest.alias("principal_cents")).where("principal_cents > 0")
    return with_rate(cut, "day_from", rates).withColumn("rate_bp", F.col("rate_bp") + margin_bp)


def interest_totals(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim_id, interest_cents), added exactly in integers and rounded once, half up."""
    sums = segments.groupBy("claim_id").agg(F.sum(F.col("principal_cents") * F.col("rate_bp") * F.col("days")).alias("s"))
    return claims.select("claim_id").join(sums, "claim_id", "left").select("claim_id", half_up(F.coalesce("s", F.lit(0)), 3_650_000).alias("interest_cents"))


def interest_as_of(days: DataFrame, segments: DataFrame) -> DataFrame:
    """(the columns of ``days``, interest_cents): the interest of a claim up to each of its days, that day included.

    ``days``: claim_id, day and more; ``segments`` as of ``interest_segments``, up to the last day or later. A claim's segments get the
    sum of those before them once; each day then finds the one segment it lies in.
    """
    line = Window.partitionBy("claim_id").orderBy("day_from").rowsBetween(Window.unboundedPreceding, -1)
    units = F.col("principal_cents") * F.col("rate_bp") * F.col("days")
    summed = segments.withColumn("earlier", F.coalesce(F.sum(units).over(line), F.lit(0))).select("claim_id", "day_from", "principal_cents", "rate_bp", "days", "earlier")
    named = written(days.withColumn("_day", F.monotonically_increasing_id()), "claim-days")  # numbered once for both joins
    begun = named.join(summed, "claim_id").where(F.col("day_from") <= F.col("day"))
    # a segment that has ended counts as far as it goes: nothing is due between the last of them and the day
    last = begun.groupBy("_day").agg(F.max_by(F.struct("day_from", "principal_cents", "rate_bp", "days", "earlier"), "day_from").alias("s"))
    held = named.join(last, "_day", "left")
    passed = F.least(F.col("s.days"), F.datediff("day", F.col("s.day_from")) + 1)
    total = F.coalesce(F.col("s.earlier") + F.col("s.principal_cents") * F.col("s.rate_bp") * passed, F.lit(0))
    return held.select(*days.columns, half_up(total, 3_650_000).alias("interest_cents"))


def compare_claims(claims: DataFrame, segments: DataFrame, flat_fee_cents: int) -> DataFrame:
    """(notice_id, invoice_id, what, claimed_cents, calculated_cents, difference_cents) of interest and flat fees that letters claim.

    ``claims``: notice_id, invoice_id, notice_date, interest_cents, flat_fee_cents. Interest is told if it is claimed or due, a
    flat fee if it is claimed.
    """
    asked = claims.select("notice_id", F.col("invoice_id").alias("claim_id"), F.col("notice_date").alias("day"), F.col("interest_cents").alias("claimed_interest"), F.col("flat_fee_cents").alias("claimed_fee"))
    due = interest_as_of(asked, segments)
    told = lambda what, claimed, calculated: F.struct(F.lit(what).alias("what"), claimed.cast("bigint").alias("claimed_cents"), calculated.cast("bigint").alias("calculated_cents"))
    rows = due.select("notice_id", F.col("claim_id").alias("invoice_id"), F.inline(F.array(told("INTEREST", F.col("claimed_interest"), F.col("interest_cents")), told("FLAT_FEE", F.col("claimed_fee"), F.lit(flat_fee_cents)))))
    fit = rows.where("claimed_cents > 0 or (what = 'INTEREST' and calculated_cents > 0)")
    return fit.withColumn("difference_cents", F.col("claimed_cents") - F.col("calculated_cents"))


def half_up(numerator: Column, denominator: int) -> Column:
    """A quotient of a number not below zero, rounded half up."""
    twice = 2 * numerator + denominator
    return ((twice - twice % (2 * denominator)) / (2 * denominator)).cast("bigint")
