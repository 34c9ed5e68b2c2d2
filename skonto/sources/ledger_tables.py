"""The ledger's tables as views of the order tables that tests and benchmarks use.

Line items have no unique key; ``part`` and ``line`` order entries of a day, and entries that agree in all of
these agree in every column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skonto import domain as D

#: The order of an account's entries.
ORDER = ("entry_date", "invoice_id", "category", "amount_cents", "part", "line")
#: Rates that cover the dates of the test tables, before those of the settings.
EARLY_RATES = (("1995-01-01", 350), ("1996-01-01", 300), ("1997-07-01", 250), ("1999-01-01", 195), ("2000-01-01", 268), ("2001-01-01", 426))


def cents(value: Column) -> Column:
    """Cents of a floating amount that is not negative, halves up; ``round`` would make a decimal of every value."""
    return F.floor(value * 100 + 0.5).cast("bigint")


@dataclass(frozen=True)
class LedgerTables:
    """DataFrames that are read only when a query needs them."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def count(self, name: str) -> DataFrame:
        """One row that joins can use: the number of rows, from the footers of the files."""
        return self.read(name).agg(F.count("*").alias(f"n_{name}"))

    @property
    def hotels(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("hotel_id"), F.col("n_regionkey").alias("company_id"), F.col("n_name").alias("name"))

    @property
    def companies(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("company_id"), F.col("r_name").alias("name"))

    @property
    def parties(self) -> DataFrame:
        agency = F.col("s_suppkey") % 10 == 9
        return self.read("supplier").select(
            F.col("s_suppkey").alias("party_id"),
            F.col("s_name").alias("name"),
            F.when(agency, D.AGENCY).otherwise(D.SUPPLIER).alias("role"),
            F.when(agency, F.col("s_suppkey") - 1).alias("represents_id"),
        )

    @property
    def invoices(self) -> DataFrame:
        o = self.read("orders").crossJoin(F.broadcast(self.count("supplier")))  # one row
        place = self.read("customer").select("c_custkey", "c_nationkey").join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        day = F.col("o_orderdate").cast("date")
        return o.join(place, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("o_orderkey").alias("invoice_id"),
            (F.col("o_custkey") % F.col("n_supplier")).alias("supplier_id"),
            F.concat(F.lit("RE-"), F.year(day), F.lit("/"), F.format_string("%06d", "o_orderkey")).alias("invoice_number"),
            day.alias("invoice_date"),
            F.date_add(day, D.PAYMENT_DAYS).alias("due_date"),
            cents(F.col("o_totalprice")).alias("gross_cents"),
            F.when(F.col("o_orderkey") % 97 == 0, D.CANCELLED).when(F.col("o_orderstatus") == "P", D.DISPUTED).otherwise(D.OPEN).alias("manual_status"),
            F.col("n_regionkey").alias("company_id"),
            F.col("n_nationkey").alias("hotel_id"),
        )

    @property
    def amounts_due(self) -> DataFrame:
        """(invoice_id, gross_cents, due_date) of all invoices: no join is needed for them."""
        due = F.date_add(F.col("o_orderdate").cast("date"), D.PAYMENT_DAYS)
        return self.read("orders").select(F.col("o_orderkey").alias("invoice_id"), cents(F.col("o_totalprice")).alias("gross_cents"), due.alias("due_date"))

    @property
    def supplier_of_invoice(self) -> DataFrame:
        o = self.read("orders").crossJoin(F.broadcast(self.count("supplier")))
        return o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % F.col("n_supplier")).alias("supplier_id"))

    @property
    def line_entries(self) -> DataFrame:
        """Entries from line items, before their supplier is known."""
        taxed, billed = cents(F.col("l_extendedprice") * F.col("l_tax")), cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        flag, open_line = F.col("l_returnflag"), F.col("l_linestatus") == "O"
        category = F.when(flag == "A", D.PAYMENT).when(flag == "R", D.CREDIT_NOTE).when(open_line, D.DUNNING_FEE).otherwise(D.LATE_INTEREST)
        return (
            self.read("lineitem")
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.when(~((flag == "A") & (F.col("l_linenumber") == 7)), F.col("l_orderkey")).alias("invoice_id"),
                F.col("l_shipdate").cast("date").alias("entry_date"),
                category.alias("category"),
                F.when(flag.isin("A", "R"), -billed).otherwise(taxed).alias("amount_cents"),
                F.col("l_partkey").alias("part"),
                F.col("l_linenumber").alias("line"),
            )
            .where("amount_cents <> 0")
        )

    @property
    def entries(self) -> DataFrame:
        """All entries; the supplier of a line comes with its order."""
        o = self.read("orders").crossJoin(F.broadcast(self.count("supplier"))).select(
            F.col("o_orderkey").alias("order_id"),
            (F.col("o_custkey") % F.col("n_supplier")).alias("supplier_id"),
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_orderdate").cast("date").alias("entry_date"),
            F.lit(D.INVOICE).alias("category"),
            cents(F.col("o_totalprice")).alias("amount_cents"),
            F.lit(0).cast("bigint").alias("part"),
            F.lit(0).alias("line"),
        )
        lines = self.line_entries.join(self.supplier_of_invoice, "order_id")
        return o.where("amount_cents <> 0").unionByName(lines).drop("order_id")

    @property
    def entries_by_invoice(self) -> DataFrame:
        """Entries that belong to invoices, without their supplier: no join is needed for them."""
        o = self.read("orders").select(
            F.col("o_orderkey").alias("invoice_id"), F.col("o_orderdate").cast("date").alias("entry_date"), F.lit(D.INVOICE).alias("category"),
            cents(F.col("o_totalprice")).alias("amount_cents"), F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("line"),
        )
        return o.where("amount_cents <> 0").unionByName(self.line_entries.drop("order_id").where("invoice_id is not null"))

    @property
    def unassigned(self) -> DataFrame:
        """Entries without an invoice: of these few alone the supplier comes with the order."""
        loose = self.line_entries.where("invoice_id is null")
        return loose.join(self.supplier_of_invoice, "order_id").drop("order_id")

    @property
    def cases(self) -> DataFrame:
        """A case for every invoice with a notice of level 4 or more, opened at the first of these."""
        worst = self.notices.where("level >= 4").groupBy("invoice_id").agg(F.min("notice_date").alias("opened_at"))
        states = F.array(*map(F.lit, ("open", "waiting", "in_dispute", "closed")))
        return worst.select(F.col("invoice_id").alias("case_id"), "invoice_id", "opened_at", F.element_at(states, (F.col("invoice_id") % 4 + 1).cast("int")).alias("status"))

    @property
    def notices(self) -> DataFrame:
        e = self.read("events").where("event_type = 'error'").crossJoin(F.broadcast(self.count("orders")))
        return e.select(
            F.col("event_id").alias("notice_id"),
            (F.col("event_id") % F.col("n_orders")).alias("invoice_id"),
            F.col("ts").cast("date").alias("notice_date"),
            (1 + F.col("event_id") % 6).cast("int").alias("level"),
            cents(F.col("value")).alias("fees_cents"),
            F.date_add(F.col("ts").cast("date"), 14).alias("new_deadline"),
        )

    @property
    def bank_lines(self) -> DataFrame:
        e = self.read("events").where("event_type = 'purchase'")
        return e.select(
            F.col("event_id").alias("tx_id"),
            F.lit(1).alias("account_id"),
            F.col("ts").cast("date").alias("booking_date"),
            (-cents(F.col("value"))).alias("amount_cents"),
            F.concat(F.lit("Kunde "), F.col("user_id")).alias("counterparty_name"),
            F.col("props").alias("purpose"),
        )

    @property
    def rates(self) -> DataFrame:
        """(valid_from, rate_bp): base rates in hundredths of a per cent."""
        rows = [F.struct(F.lit(d).cast("date").alias("valid_from"), F.lit(r).alias("rate_bp")) for d, r in EARLY_RATES]
        return self.spark.range(1).select(F.inline(F.array(*rows)))
