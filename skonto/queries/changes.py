"""Notices to book, later changes, bank lines and documents that wait for a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skonto import domain as D
from skonto.operators import changes as C
from skonto.plans import inbox as I
from skonto.queries.base import AS_OF, BANK, LEDGER, NOTICES
from skonto.sources.ledger_tables import LedgerTables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function of the ledger's tables, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(LedgerTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


AGAIN = 10_000_000
_PARTIES = """parties AS (SELECT s_suppkey AS party_id, CASE WHEN s_suppkey % 10 = 9 THEN 'collection_agency' ELSE 'supplier' END AS role, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 END AS represents_id FROM supplier)"""
_DRAFTS = f"""{LEDGER},{NOTICES}, {_PARTIES},
once AS (SELECT notice_id, notice_id AS of_id FROM notices UNION ALL SELECT notice_id + {AGAIN}, notice_id FROM notices WHERE notice_id % 7 = 0),
drafts AS (SELECT o.notice_id, of_id, invoice_id, notice_date, level, new_deadline, fees_cents, gross_cents, supplier_id AS owner_id, CASE WHEN of_id % 3 = 0 THEN supplier_id END AS given,
    CASE WHEN of_id % 5 = 0 THEN supplier_id + 1 ELSE supplier_id END AS sender_id, CASE WHEN of_id % 2 = 0 THEN gross_cents ELSE 0 END AS stated
  FROM once o JOIN notices n ON n.notice_id = of_id JOIN invoices USING (invoice_id)),
claims AS (SELECT notice_id, invoice_id, gross_cents AS principal_cents, fees_cents, fees_cents // 2 AS interest_cents, 0 AS flat_fee_cents, 0 AS other_costs_cents,
    CASE WHEN of_id % 4 = 0 THEN gross_cents ELSE 0 END AS total_cents FROM drafts WHERE of_id % 11 <> 0),
keyed AS (SELECT d.*, c.invoice_id AS claimed_id, principal_cents, c.fees_cents AS f, interest_cents AS i, total_cents, role,
    coalesce(given, CASE WHEN role = 'collection_agency' THEN represents_id WHEN role IS NOT NULL THEN sender_id END) AS sid
  FROM drafts d LEFT JOIN claims c USING (notice_id) LEFT JOIN parties ON party_id = sender_id),
digest AS (SELECT *, sha256(concat_ws('|', sid, sender_id, notice_date, level, stated, CASE WHEN claimed_id IS NOT NULL THEN concat_ws(':', claimed_id, principal_cents, f, i, 0, 0, total_cents) END)) AS dedup_key,
    CASE WHEN claimed_id IS NULL THEN 'NO_CLAIM' WHEN sid IS NULL THEN CASE WHEN role IS NULL THEN 'UNKNOWN_SENDER' ELSE 'REPRESENTS_NOBODY' END WHEN sid IS DISTINCT FROM owner_id THEN 'OTHER_SUPPLIER' END AS wrong FROM keyed),
planned AS (SELECT *, coalesce(wrong, CASE WHEN notice_id > min(CASE WHEN wrong IS NULL THEN notice_id END) OVER (PARTITION BY dedup_key) THEN 'DUPLICATE' END) AS error FROM digest)"""


def _drafts(t: LedgerTables) -> tuple[DataFrame, DataFrame]:
    """Letters about every notice, some sent twice, some by an agency or a stranger, some without a claim."""
    n = t.notices.join(t.invoices.select("invoice_id", "supplier_id", "gross_cents"), "invoice_id")
    twice = F.explode(F.when(F.col("notice_id") % 7 == 0, F.array("notice_id", F.col("notice_id") + AGAIN)).otherwise(F.array("notice_id")))
    d = n.withColumnRenamed("notice_id", "of_id").withColumn("notice_id", F.col("of_id")).withColumn("notice_id", twice)
    zero = F.lit(0).cast("bigint")
    drafts = d.select(
        "notice_id", F.when(F.col("of_id") % 5 == 0, F.col("supplier_id") + 1).otherwise(F.col("supplier_id")).alias("sender_id"), F.when(F.col("of_id") % 3 == 0, F.col("supplier_id")).alias("supplier_id"),
        "notice_date", "level", "new_deadline", F.when(F.col("of_id") % 2 == 0, F.col("gross_cents")).otherwise(zero).alias("total_claimed_cents"),
    )
    claims = d.where("of_id % 11 <> 0").select(
        "notice_id", "invoice_id", F.col("gross_cents").alias("principal_cents"), "fees_cents", F.floor(F.col("fees_cents") / 2).cast("bigint").alias("interest_cents"),
        zero.alias("flat_fee_cents"), zero.alias("other_costs_cents"), F.when(F.col("of_id") % 4 == 0, F.col("gross_cents")).otherwise(zero).alias("total_cents"),
    )
    return drafts, claims


def _planned(t: LedgerTables) -> tuple[DataFrame, DataFrame]:
    drafts, claims = _drafts(t)
    return C.book_notices(drafts, claims, t.parties, t.invoices, t.spark.createDataFrame([], "dedup_key string")), claims


@query(f"""{_DRAFTS} SELECT notice_id, sid AS supplier_id, sender_id, notice_date, level, new_deadline, principal_cents, f AS fees_cents, i AS interest_cents, CASE WHEN claimed_id IS NOT NULL THEN 0 END AS flat_fee_cents,
  CASE WHEN claimed_id IS NOT NULL THEN 0 END AS other_costs_cents, CASE WHEN stated <> 0 THEN stated WHEN total_cents > 0 THEN total_cents ELSE principal_cents + f + i END AS total_claimed_cents, dedup_key, error FROM planned""")
def notices_to_book(t: LedgerTables) -> DataFrame:
    """Which letters are booked, for whom, and why others are not."""
    return _planned(t)[0]


@query(f"""{_DRAFTS},
had AS (SELECT invoice_id, coalesce(sum(amount_cents) FILTER (category = 'DUNNING_FEE'), 0) AS f0, coalesce(sum(amount_cents) FILTER (category = 'LATE_INTEREST'), 0) AS i0 FROM entries WHERE category IN ('DUNNING_FEE', 'LATE_INTEREST') GROUP BY 1),
good AS (SELECT notice_id, invoice_id, sid, notice_date, f, i, coalesce(f0, 0) AS f0, coalesce(i0, 0) AS i0 FROM planned LEFT JOIN had USING (invoice_id) WHERE error IS NULL),
parts AS (SELECT notice_id, invoice_id, sid, notice_date, 'DUNNING_FEE' AS category, f AS claimed, f0 AS had FROM good UNION ALL SELECT notice_id, invoice_id, sid, notice_date, 'LATE_INTEREST', i, i0 FROM good),
w AS (SELECT *, greatest(had, 0, coalesce(max(claimed) OVER (PARTITION BY invoice_id, category ORDER BY notice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM parts),
p AS (SELECT *, greatest(0, claimed - b) AS posted, CASE WHEN claimed > 0 AND claimed < b THEN b - claimed ELSE 0 END AS lower_by FROM w)
SELECT notice_id, invoice_id, category, CAST(posted AS BIGINT) AS posted_cents, CAST(lower_by AS BIGINT) AS lower_cents, sid AS supplier_id, notice_date AS entry_date FROM p WHERE posted > 0 OR lower_by > 0""")
def notice_bookings(t: LedgerTables) -> DataFrame:
    """What booked letters add to the charges that the ledger has."""
    planned, claims = _planned(t)
    return C.notice_postings(planned, claims, I.booked_charges(t.entries_by_invoice))


@query(f"""{_DRAFTS} SELECT invoice_id, arg_min(notice_date, notice_id) AS opened_at FROM planned WHERE error IS NULL AND invoice_id NOT IN (SELECT invoice_id FROM notices WHERE level >= 4) GROUP BY 1""")
def cases_to_open(t: LedgerTables) -> DataFrame:
    planned, claims = _planned(t)
    return C.cases_to_open(planned, claims, t.cases)


@query(f"""{LEDGER}, r AS (SELECT CASE WHEN invoice_id % 13 = 0 THEN -invoice_id - 1 ELSE invoice_id END AS invoice_id, invoice_date + CAST(invoice_id % 50 - 10 AS INTEGER) AS new FROM invoices),
x AS (SELECT invoice_id, due_date AS old, new, CASE WHEN invoice_date IS NULL THEN 'UNKNOWN_INVOICE' WHEN new < invoice_date THEN 'DUE_BEFORE_DATE' END AS error FROM r LEFT JOIN invoices USING (invoice_id))
SELECT invoice_id, old, new, error IS NULL AND new <> old AS changed, error FROM x""")
def due_date_changes(t: LedgerTables) -> DataFrame:
    """A new due date for every invoice, a few of them unknown."""
    i = F.col("invoice_id")
    return C.change_due_dates(t.invoices.select(F.when(i % 13 == 0, -i - 1).otherwise(i).alias("invoice_id"), F.date_add("invoice_date", (i % 50 - 10).cast("int")).alias("due_date")), t.invoices)


@query(f"""{LEDGER}, h AS (SELECT n_nationkey AS hotel_id, n_regionkey AS its FROM nation),
r AS (SELECT invoice_id, CAST(invoice_id % 7 AS INTEGER) AS company_id, CASE WHEN invoice_id % 2 = 0 THEN CAST(invoice_id % 27 AS INTEGER) END AS hotel_id FROM invoices)
SELECT invoice_id, CASE WHEN hotel_id IS NOT NULL THEN its ELSE company_id END AS company_id, hotel_id,
  CASE WHEN hotel_id IS NOT NULL AND its IS NULL THEN 'UNKNOWN_HOTEL' WHEN hotel_id IS NULL AND company_id NOT IN (SELECT r_regionkey FROM region) THEN 'UNKNOWN_COMPANY' END AS error FROM r LEFT JOIN h USING (hotel_id)""")
def scope_changes(t: LedgerTables) -> DataFrame:
    i = F.col("invoice_id")
    asked = t.invoices.select("invoice_id", (i % 7).cast("int").alias("company_id"), F.when(i % 2 == 0, (i % 27).cast("int")).alias("hotel_id"))
    return C.assign_scopes(asked, t.invoices, t.hotels, t.companies)


_LINES = f"""WITH {BANK}, {_PARTIES},
lines AS (SELECT *, ['new', 'matched', 'booked', 'ignored'][tx_id % 4 + 1] AS status, CASE WHEN tx_id % 3 > 0 THEN tx_id % (SELECT count(*) FROM supplier) END AS supplier_id FROM bank)"""


def _lines(t: LedgerTables) -> DataFrame:
    x = F.col("tx_id")
    states = F.array(*map(F.lit, (D.TX_NEW, D.TX_MATCHED, D.TX_BOOKED, D.TX_IGNORED)))
    lines = t.bank_lines.crossJoin(F.broadcast(t.count("supplier")))  # one row
    return lines.withColumns({"status": F.element_at(states, (x % 4 + 1).cast("int")), "supplier_id": F.when(x % 3 > 0, x % F.col("n_supplier"))}).drop("n_supplier")


@query(f"""{_LINES}, r AS (SELECT tx_id, ['assign', 'ignore', 'reopen'][tx_id % 3 + 1] AS action, CASE WHEN tx_id % 5 > 0 THEN tx_id % (SELECT count(*) + 3 FROM supplier) END AS to_id FROM bank),
x AS (SELECT r.*, status, supplier_id, CASE WHEN status = 'booked' THEN 'BOOKED' WHEN action = 'assign' AND to_id IS NOT NULL AND (role IS NULL OR role = 'collection_agency') THEN 'NO_SUPPLIER' END AS error, amount_cents < 0 AS goes_out
  FROM r JOIN lines USING (tx_id) LEFT JOIN parties ON party_id = to_id)
SELECT tx_id, CASE WHEN error IS NOT NULL THEN status WHEN action = 'ignore' THEN 'ignored' WHEN action = 'assign' AND to_id IS NOT NULL AND goes_out THEN 'matched' ELSE 'new' END AS status,
  CASE WHEN error IS NULL AND action = 'assign' THEN to_id ELSE supplier_id END AS supplier_id, CASE WHEN error IS NULL AND action = 'assign' THEN CASE WHEN to_id IS NOT NULL AND goes_out THEN 1.0 ELSE 0.0 END ELSE 0.5 END::DOUBLE AS confidence, error FROM x""")
def line_decisions(t: LedgerTables) -> DataFrame:
    """Each bank line is assigned, ignored or reopened."""
    x = F.col("tx_id")
    lines = _lines(t).withColumns({"invoice_ids": F.array("tx_id"), "confidence": F.lit(0.5), "note": F.lit("")})
    asked = t.bank_lines.crossJoin(F.broadcast(t.count("supplier"))).select(
        "tx_id", F.element_at(F.array(*map(F.lit, ("assign", "ignore", "reopen"))), (x % 3 + 1).cast("int")).alias("action"), F.when(x % 5 > 0, x % (F.col("n_supplier") + 3)).alias("supplier_id"),
        F.array("tx_id").alias("invoice_ids"), F.lit(None).cast("string").alias("note"),
    )
    return C.decide_lines(asked, lines, t.parties).select("tx_id", "status", "supplier_id", "confidence", "error")


@query(f"""{_LINES}, pay AS (SELECT tx_id AS payment_id, supplier_id, booking_date + 3 AS payment_date, -amount_cents AS payment_cents FROM lines WHERE tx_id % 5 = 1 AND supplier_id IS NOT NULL)
SELECT tx_id, supplier_id, booking_date AS payment_date, -amount_cents AS payment_cents, CASE WHEN status = 'booked' THEN 'BOOKED' WHEN amount_cents >= 0 THEN 'INCOMING' WHEN supplier_id IS NULL THEN 'NO_SUPPLIER'
  WHEN EXISTS (SELECT 1 FROM pay p WHERE p.supplier_id = l.supplier_id AND p.payment_cents = -l.amount_cents AND abs(date_diff('day', p.payment_date, l.booking_date)) <= 5) THEN 'PAYMENT_EXISTS' END AS error FROM lines l""")
def lines_to_book(t: LedgerTables) -> DataFrame:
    """Each bank line as a payment; every fifth has been paid already."""
    lines = _lines(t).withColumns({"invoice_ids": F.array("tx_id"), "reference": F.lit("NOTPROVIDED"), "counterparty_iban": F.lit("")})
    there = lines.where("tx_id % 5 = 1 and supplier_id is not null").select(F.col("tx_id").alias("payment_id"), "supplier_id", F.date_add("booking_date", 3).alias("payment_date"), F.abs("amount_cents").alias("payment_cents"))
    return C.book_lines(lines, there).select("tx_id", "supplier_id", "payment_date", "payment_cents", "error")


@query(f"{_LINES} SELECT count(*) FILTER (status IN ('new', 'matched')) AS waiting, count(*) FILTER (status = 'matched') AS matched FROM lines")
def bank_waiting(t: LedgerTables) -> DataFrame:
    return I.bank_waiting(_lines(t))


@query(f"{_LINES} SELECT tx_id, status FROM lines WHERE status IN ('new', 'matched') AND supplier_id = 5")
def bank_page(t: LedgerTables) -> DataFrame:
    """Open bank lines of a supplier."""
    return I.bank_page(_lines(t), "open", supplier_id=5).select("tx_id", "status")


_DOCS = """WITH docs AS (SELECT doc_id, ['invoice', 'first_dunning', 'court_order', 'other'][doc_id % 4 + 1] AS doc_type, ['pending', 'needs_review', 'accepted', 'rejected', 'accepted'][doc_id % 5 + 1] AS review_status,
  (doc_id * 37 % 100) AS percent, CASE WHEN doc_id % 6 > 0 THEN doc_id % 10 END AS supplier_id, doc_id % 5 = 4 AND doc_id % 2 = 0 AS assignment_pending FROM documents)"""


def _docs(t: LedgerTables) -> DataFrame:
    d, pick = F.col("doc_id"), lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % n + 1).cast("int"))
    return t.read("documents").select(
        "doc_id", pick(4, "invoice", "first_dunning", "court_order", "other").alias("doc_type"), pick(5, "pending", "needs_review", "accepted", "rejected", "accepted").alias("review_status"),
        (d * 37 % 100 / 100).alias("confidence"), F.when(d % 6 > 0, d % 10).alias("supplier_id"), ((d % 5 == 4) & (d % 2 == 0)).alias("assignment_pending"),
    )


@query(f"""{_DOCS}, r AS (SELECT * FROM docs WHERE review_status IN ('pending', 'needs_review') AND (supplier_id IS NULL OR supplier_id = 1))
SELECT 'new_notices' AS list, doc_id, doc_type, CAST(percent AS INTEGER) AS percent FROM r WHERE doc_type IN ('first_dunning', 'court_order')
UNION ALL SELECT 'low_confidence', doc_id, doc_type, CAST(percent AS INTEGER) FROM r WHERE review_status = 'needs_review' OR percent < 75""")
def document_attention(t: LedgerTables) -> DataFrame:
    """All documents that wait for a review, of one supplier or of nobody."""
    return I.document_attention(_docs(t), supplier_id=1, most=None)


@query(f"""{_DOCS}, {LEDGER.removeprefix('WITH ')} SELECT doc_id, min(invoice_id) AS invoice_id FROM docs d LEFT JOIN invoices i ON i.supplier_id = d.supplier_id AND i.invoice_id = doc_id * 3 WHERE assignment_pending GROUP BY doc_id""")
def unassigned_documents(t: LedgerTables) -> DataFrame:
    """Filed documents without an invoice, and the invoice that has come since."""
    number = t.invoices.select((F.col("invoice_id") / 3).cast("bigint").alias("doc_id"), "invoice_id", "invoice_number").where("invoice_id % 3 = 0").drop("invoice_id")
    docs = _docs(t).join(number, "doc_id", "left")
    refs = F.array(F.struct(F.lit("customer_number").alias("ref_type"), F.lit("K1").alias("value")), F.struct(F.lit("invoice_number").alias("ref_type"), F.lower("invoice_number").alias("value")))
    return I.unassigned_documents(docs.withColumn("pending_json", F.to_json(F.struct(refs.alias("references")))), t.invoices)


@query("""WITH log AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M') AS created_at, ['import', 'create', 'login', 'reverse'][event_id % 4 + 1] AS action, ['document', 'invoice', 'user', 'payment', 'case'][event_id % 5 + 1] AS entity,
  user_id AS entity_id, event_type AS details FROM events), newest AS (SELECT * FROM log ORDER BY id DESC LIMIT 36)
SELECT * FROM newest WHERE (action, entity) IN (('import', 'document'), ('create', 'invoice'), ('create', 'payment'), ('reverse', 'payment')) ORDER BY id DESC LIMIT 12""")
def activity(t: LedgerTables) -> DataFrame:
    """What has been done lately."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    return I.activity(t.read("events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), pick(4, "import", "create", "login", "reverse").alias("action"), pick(5, "document", "invoice", "user", "payment", "case").alias("entity"),
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("details"),
    ))


@query(f"""{LEDGER}, pays AS (SELECT invoice_id AS payment_id, unnest([invoice_id, invoice_id + 1]) AS invoice_id FROM invoices)
SELECT payment_id, CASE WHEN count(company_id) = count(*) AND min(company_id) = max(company_id) THEN min(company_id) END AS company_id, CASE WHEN count(hotel_id) = count(*) AND min(hotel_id) = max(hotel_id) THEN min(hotel_id) END AS hotel_id
FROM pays JOIN invoices USING (invoice_id) GROUP BY 1""")
def payment_scopes(t: LedgerTables) -> DataFrame:
    """What the two invoices of each payment have in common."""
    pays = t.invoices.select(F.col("invoice_id").alias("payment_id"), F.explode(F.array("invoice_id", F.col("invoice_id") + 1)).alias("invoice_id"))
    return I.payment_scopes(pays, t.invoices)


@query(f"""{LEDGER} SELECT s_suppkey AS supplier_id, s_suppkey IN (SELECT supplier_id FROM invoices WHERE hotel_id = 7) OR s_suppkey IN (SELECT supplier_id FROM entries WHERE entry_date > DATE '{AS_OF}' AND invoice_id IS NULL) AS has_items FROM supplier""")
def suppliers_with_business(t: LedgerTables) -> DataFrame:
    """Suppliers with an invoice of a hotel, or with entries of late that no invoice has."""
    late = t.unassigned.where(F.col("entry_date") > F.lit(AS_OF))
    return I.has_items(t.parties.select(F.col("party_id").alias("supplier_id")), "supplier_id", t.invoices.where("hotel_id = 7"), late)


_NORM = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"""WITH said AS (SELECT o_orderkey AS doc_id, 'An ' || coalesce(n_name, '') || ', Region ' || r_name || CASE WHEN o_orderkey % 3 = 0 THEN ', ' ELSE '' END AS text
  FROM orders JOIN region ON r_regionkey = o_orderkey % 5 LEFT JOIN nation ON n_nationkey = o_orderkey % 30),
h AS (SELECT doc_id, min(n_nationkey) AS hotel_id FROM said JOIN nation ON contains({_NORM.format('text')}, {_NORM.format('n_name')}) GROUP BY 1),
c AS (SELECT doc_id, min(r_regionkey) AS company_id FROM said JOIN region ON contains({_NORM.format('text')}, {_NORM.format('r_name')}) GROUP BY 1)
SELECT doc_id, coalesce(n_regionkey, c.company_id) AS company_id, hotel_id FROM said LEFT JOIN h USING (doc_id) LEFT JOIN nation ON n_nationkey = hotel_id LEFT JOIN c USING (doc_id)""")
def scope_in_text(t: LedgerTables) -> DataFrame:
    """The hotel or company that a text about each order names."""
    k = F.col("o_orderkey")
    said = t.read("orders").join(F.broadcast(t.read("region")), F.col("r_regionkey") == k % 5).join(F.broadcast(t.read("nation")), F.col("n_nationkey") == k % 30, "left")  # five and 25 rows
    return I.scope_in_text(said.select(k.alias("doc_id"), F.concat(F.lit("An "), F.coalesce("n_name", F.lit("")), F.lit(", Region "), "r_name").alias("text")), t.hotels, t.companies)
