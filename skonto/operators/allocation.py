"""Payments spread over open items, in the order of the law or oldest first.

What stands before a part in its supplier's order is a running sum over the parts alone, made month by month, so that a large
supplier is several groups. A payment then takes the parts of which less stands before than it is worth: parts are filed by the
power of two of that sum, and a payment looks into the files up to its own power, so it meets hardly more parts than it pays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto import domain as D

STAGES = ((D.COSTS, 0), (D.INTEREST, 1), (D.PRINCIPAL, 2))


def open_parts(items: DataFrame) -> DataFrame:
    """One row for each open component of an item: component, stage, open_part_cents (positive only)."""
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k).alias("stage"), F.col(f"open_{c}_cents").alias("open_part_cents")) for c, k in STAGES])
    keep = [c for c in items.columns if c not in {f"open_{c}_cents" for c, _ in STAGES}]
    return items.select(*keep, F.inline(parts)).where("open_part_cents > 0")


def allocate(payments: DataFrame, items: DataFrame, rule: str = D.STATUTORY) -> DataFrame:
    """(payment_id, invoice_id, component, allocated_cents) of payments on the open items of their supplier.

    ``payments``: payment_id, supplier_id, payment_cents; ``items``: supplier_id, invoice_id, due_date, invoice_date and the
    three open components. Each payment is seen alone. Statutory: costs, then interest, then principal, each oldest
    first; else the oldest invoice first, with its costs, interest and principal.
    """
    age = [F.coalesce("due_date", "invoice_date"), F.col("invoice_date"), F.col("invoice_id")]
    order = [F.col("stage"), *age] if rule == D.STATUTORY else [*age, F.col("stage")]
    month = F.coalesce(F.year(age[0]) * 12 + F.month(age[0]), F.lit(0))
    stage = F.col("stage") if rule == D.STATUTORY else F.lit(0)
    parts = open_parts(items).withColumn("chunk", stage * 1_000_000 + month)
    # chunks of a supplier stand in order; their sums are a few hundred rows a supplier
    chunks = parts.groupBy("supplier_id", "chunk").agg(F.sum("open_part_cents").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("supplier_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    upto = Window.partitionBy("supplier_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parts.withColumn("within", F.sum("open_part_cents").over(upto) - F.col("open_part_cents"))
    placed = inside.join(chunks.select("supplier_id", "chunk", earlier.alias("earlier")), ["supplier_id", "chunk"]).withColumn("before", F.col("earlier") + F.col("within"))
    power = lambda c: F.length(F.conv(c.cast("string"), 10, 2))
    filed = placed.select("supplier_id", "invoice_id", "component", "open_part_cents", "before", F.when(F.col("before") == 0, 0).otherwise(power(F.col("before"))).alias("file"))
    asking = payments.where("payment_cents > 0").select("payment_id", "supplier_id", "payment_cents", F.explode(F.sequence(F.lit(0), power(F.col("payment_cents")))).alias("file"))
    met = asking.join(filed, ["supplier_id", "file"]).where("before < payment_cents")
    return met.select("payment_id", "invoice_id", "component", F.least("open_part_cents", F.col("payment_cents") - F.col("before")).alias("allocated_cents"))


def unallocated(payments: DataFrame, allocated: DataFrame) -> DataFrame:
    """(payment_id, supplier_id, rest_cents): what of each payment no item took."""
    used = allocated.groupBy("payment_id").agg(F.sum("allocated_cents").alias("used"))
    rest = F.col("payment_cents") - F.coalesce("used", F.lit(0))
    return payments.join(used, "payment_id", "left").select("payment_id", "supplier_id", rest.alias("rest_cents"))


def check_manual(wanted: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """``wanted`` (payment_id, invoice_id, component, allocated_cents) with ``error``: what forbids it, else null."""
    known = open_parts(items).select("invoice_id", "component", "open_part_cents")
    total = Window.partitionBy("payment_id")
    return (
        wanted.join(known, ["invoice_id", "component"], "left")
        .join(payments.select("payment_id", "payment_cents"), "payment_id", "left")
        .withColumn(
            "error",
            F.when(F.col("allocated_cents") < 0, "NEGATIVE")
            .when(F.col("open_part_cents").isNull(), "NOT_OPEN")
            .when(F.col("allocated_cents") > F.col("open_part_cents"), "ABOVE_OPEN")
            .when(F.sum("allocated_cents").over(total) > F.col("payment_cents"), "ABOVE_PAYMENT"),
        )
        .drop("open_part_cents", "payment_cents")
    )
