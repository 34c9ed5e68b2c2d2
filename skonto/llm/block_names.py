"""Exact duplicates by deterministic block naming.

A text, without the characters that don't count, is cut into blocks of fixed size. Different blocks are sorted and get
integer names; then adjacent names are paired and different pairs are sorted and named in turn, until one name is left of each
text. Two texts end with the same name after as many rounds if, and only if, they are equal: names are compared by the
blocks and pairs themselves, hashes only choose where a block is sorted.

How it is spread: blocks are sorted in buckets of their hash, so the text is shuffled once and only integers after that.
Blocks that occur most often are counted before (hashes alone are shuffled), dealt over ``SALTS`` parts of their bucket,
and the names that the parts give them are made one by the few blocks kept from each part. Pairs are made different in
partial aggregates before they are sorted. Each round is written to the shared folder. There are as many rounds as the
number of blocks of the longest text can be halved.

Defined cases: a null text is an empty one; texts of deleted characters alone are empty, and empty texts are equal; rows
without an id are documents too and stay only if no row with an id is as long; of rows that repeat an id and a length any
one stays; no rows give no rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm.common import materialise

#: Characters that don't count, as a class of a regular expression.
DELETED = r"[\x20\x09-\x0D]"
BLOCK_BYTES = 2048
#: Sorting is done in so many buckets; so many of the commonest blocks are dealt over so many parts each.
BUCKETS, HOT, SALTS = 1 << 20, 1024, 64
ROW = "_row"


def squeezed(text: Column, deleted: str = DELETED) -> Column:
    """The text without the deleted characters; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{deleted}+", "")


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with a row for each block of ``norm``: its place ``pos``, the ``block`` and its hash; ``n`` blocks in all."""
    counted = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / size)).cast("int"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(cast(norm as binary), i * {size} + 1, {size}))")
    return counted.select(*[c for c in counted.columns if c != "norm"], F.posexplode(cut).alias("pos", "block")).withColumn("hash", F.xxhash64("block"))


def common_hashes(blocks: DataFrame, most: int = HOT) -> DataFrame:
    """Hashes of the ``most`` blocks that occur most often; any other block is less than one in ``most`` of all."""
    repeated = blocks.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1")
    return repeated.orderBy(F.desc("k"), "hash").limit(most).select("hash")


def block_names(blocks: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """``blocks`` with an integer ``name`` for each different block, in place of the block and its hash."""
    dealt = blocks.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "hash", "left").select(
        *[c for c in blocks.columns if c != "hash"],
        F.pmod("hash", F.lit(BUCKETS)).alias("bucket"),
        F.when(F.col("hot"), F.pmod(F.xxhash64(ROW, "pos"), F.lit(salts))).otherwise(0).alias("salt"),
        F.col("hot").isNotNull().alias("hot"),
    )
    sort = Window.partitionBy("bucket", "salt").orderBy("block")
    ranked = dealt.withColumn("rank", F.dense_rank().over(sort)).withColumn("first", F.coalesce(F.lag("rank").over(sort) != F.col("rank"), F.lit(True)))
    local = (F.col("bucket") * (salts << 32) + F.col("salt") * (1 << 32) + F.col("rank")).alias("name")
    kept = [c for c in dealt.columns if c not in ("block", "bucket", "salt", "hot")]
    named = materialise(ranked.select(*kept, local, "hot", F.when(F.col("hot") & F.col("first"), F.col("block")).alias("block")), "block-names")
    # each part of a common block's bucket has named it; the smallest of these names counts (HOT x SALTS rows at most
    # beside those of blocks that share a hash with a common one)
    parts = named.where("block is not null").select("name", "block")
    one = parts.join(parts.groupBy("block").agg(F.min("name").alias("common")), "block").select("name", "common")
    return named.drop("block", "hot").join(F.broadcast(one), "name", "left").withColumn("name", F.coalesce("common", "name")).drop("common")


def pair_names(pairs: DataFrame) -> DataFrame:
    """``pairs`` with an integer ``name`` for each different pair (``a``, ``b``), in place of it; ``b`` may be null."""
    different = pairs.select("a", F.coalesce("b", F.lit(-1)).alias("b")).distinct()
    sort = Window.partitionBy("bucket").orderBy("a", "b")
    names = different.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS))).select(
        "a", "b", (F.col("bucket") * (1 << 32) + F.row_number().over(sort)).alias("name")
    )
    return pairs.withColumn("b", F.coalesce("b", F.lit(-1))).join(names, ["a", "b"]).drop("a", "b")


def identities(rows: DataFrame, size: int = BLOCK_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(row, level, name) of every row of ``rows`` (a row number, ``norm``, other columns), and the other columns by row.

    Two rows have the same ``level`` and ``name`` if, and only if, they have the same ``norm``.
    """
    others = [c for c in rows.columns if c not in (ROW, "norm")]
    blocks = blocks_of(rows, size)
    common = materialise(common_hashes(blocks.select("hash"), hot), "common-blocks")
    first = blocks.select(ROW, "n", "pos", "block", "hash", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in others])
    named = block_names(first, common)
    named = materialise(named, "named-blocks")
    about = named.where("pos = 0").select(ROW, *others)
    now, level = named.select(ROW, "n", "pos", "name"), 0
    done = now.where("n = 1").select(ROW, F.lit(0).alias("level"), "name")
    left = now.where("n > 1")
    while left.limit(1).count():
        level += 1
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = left.groupBy(ROW, half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
            F.ceil(F.first("n") / 2).cast("int").alias("n"),
        )
        now = materialise(pair_names(materialise(pairs, "pairs")), "named-pairs")
        done = done.unionByName(now.where("n = 1").select(ROW, F.lit(level).alias("level"), "name"))
        left = now.where("n > 1")
    return done, about


def exact_groups(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: str = DELETED, size: int = BLOCK_BYTES, hot: int = HOT, number: str | None = None
) -> DataFrame:
    """One row per document row: ``_row`` (its number), doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the most code points, then the smallest id, is kept. ``number`` may name a
    column of different longs; otherwise rows are numbered as they are read.
    """
    number = F.col(number) if number else F.monotonically_increasing_id()
    body = F.col(text).cast("string")
    rows = documents.select(
        number.alias(ROW),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.char_length(body), F.lit(0)).alias("points"),
        squeezed(body, deleted).alias("norm"),
    ).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    done, about = identities(rows, size, hot)
    each = materialise(done.join(about, ROW), "document-names")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("q"), "doc_id", ROW)).alias("best")
    # written, so that the join below may split the rows of a large group
    groups = materialise(each.groupBy("level", "name").agg(F.count("*").alias("group_size"), best), "groups")
    return each.join(groups, ["level", "name"]).select(
        ROW,
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: str = DELETED, size: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns."""
    name = next(x for x in (f"{ROW}{'_' * k}" for k in range(len(documents.columns) + 1)) if x not in documents.columns)
    numbered = materialise(documents.withColumn(name, F.monotonically_increasing_id()), "numbered-documents")
    kept = exact_groups(numbered, doc_id, text, deleted, size, number=name).where("kept").select(F.col(ROW).alias(name))
    return numbered.join(kept, name, "left_semi").drop(name)
