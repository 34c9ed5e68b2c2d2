"""Sharding by sampled splitters: near-equal bytes for every shard, equal texts side by side.

Rows are ordered by a hash of their text. A sample in which a row's chance grows with its size gives the quantiles at
which the order is cut into many small ranges; their real sizes are then counted. In a range that is overfull the texts
whose copies fill it are taken out and subdivided by a hash of the row's number. The resulting cells stand in order; running
sums within them give every text its place in all bytes, and the place gives the shard. Rows are numbered cell by cell, so
no task gets a whole shard.

Copies of a text stay in one shard, unless they hold more than a range's share of all bytes (1/1024 here): such a text is
cut between rows where a shard ends, so it lies in as few shards as its bytes allow and at most one more. A shard's bytes are
off an equal share by less than the copies of one text that is not cut at each end.

Defined cases: a null text has no bytes and size 1, and is grouped with empty texts; rows without an id and rows that
repeat are rows of their own, whatever their text; texts whose 64-bit hashes agree to 53 bits count as copies of one text
when cells are made, which changes no law; columns other than the named ones are ignored, whatever they are called; no
rows give no rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skonto.llm.common import materialise

SHARDS = 8
#: Ranges for each shard, and expected sampled rows for each range.
RANGES, SAMPLED = 128, 16


def splitters(rows: DataFrame, total: int, ranges: int, sampled: int) -> list[float]:
    """Quantile boundaries of ``place`` from a sample of about ``ranges * sampled`` rows, drawn by size."""
    wanted = ranges * sampled
    draw = F.pmod(F.xxhash64("row", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    weight = F.col("size") * (wanted / max(total, 1))
    sample = rows.where(draw < weight).select("place", F.greatest(F.lit(1.0), weight).alias("weight")).toArrow()
    drawn = sorted(zip(sample["place"].to_pylist(), sample["weight"].to_pylist()))
    step, filled, cuts = sum(w for _, w in drawn) / ranges, 0.0, []
    for place, weight_ in drawn:
        filled += weight_
        if filled >= step * (len(cuts) + 1) and (not cuts or place > cuts[-1]):
            cuts.append(place)
    return cuts


def shard(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, ranges: int = RANGES, sampled: int = SAMPLED) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, shard and slot (the gapless number in the shard)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = materialise(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).cast("double").alias("place"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    cuts = splitters(rows, total, shards * ranges, sampled)
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="at").transform(rows) if cuts else rows.withColumn("at", F.lit(0.0))

    # Copies of one text that fill more than a range of the wanted size are subdivided.
    target = max(1, total // (shards * ranges))
    overfull = ranged.groupBy("at").agg(F.sum("size").alias("n")).where(F.col("n") > 2 * target).select("at")
    hot = (
        ranged.join(F.broadcast(overfull), "at")
        .groupBy("place")
        .agg(F.sum("size").alias("n"))
        .where(F.col("n") > target)
        .select("place", F.ceil(F.col("n") / target).alias("parts"))
    )
    # rows of a hot text are dealt by their number: ids may repeat or be null
    part = F.coalesce(1 + F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts")), F.lit(0))
    first = F.when(F.col("parts").isNotNull(), F.col("place")).otherwise(F.lit(float("-inf")))
    # hot texts fill a range each, so there are no more of them than ranges
    celled = ranged.join(F.broadcast(hot), "place", "left").withColumn("cell", F.struct(F.col("at"), first.alias("hot"), part.alias("part")))

    # A few thousand cells, however many rows: their order and sizes may come to the driver.
    spark, filled, before = documents.sparkSession, 0, []
    for cell, n in sorted((tuple(r.cell), r.n) for r in celled.groupBy("cell").agg(F.sum("size").alias("n")).collect()):
        before.append((cell, filled))
        filled += n
    kind = "cell struct<at:double,hot:double,part:long>"
    bases = F.broadcast(spark.createDataFrame(before, f"{kind}, before long"))
    # copies of a text end together, rows of a hot text each at its own place
    cut = F.when(F.col("parts").isNotNull(), F.col("row")).otherwise(F.lit(-1))
    within = Window.partitionBy("cell")
    upto = F.sum("size").over(within.orderBy("place", "cut"))
    number = F.row_number().over(within.orderBy("place", "cut", "row"))
    to = F.least(F.lit(shards - 1), F.expr(f"((before + upto - 1) * {shards}) div {max(total, 1)}")).cast("int")
    placed = celled.withColumn("cut", cut).withColumn("number", number).withColumn("upto", upto).join(bases, "cell").withColumn("shard", to)
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "cell", "number"), "placed")

    count, found = [0] * shards, []
    for cell, to, least, k in sorted((tuple(r.cell), r.shard, r.least, r.k) for r in placed.groupBy("cell", "shard").agg(F.min("number").alias("least"), F.count("*").alias("k")).collect()):
        found.append((cell, to, count[to] - least))
        count[to] += k
    slots = F.broadcast(spark.createDataFrame(found, f"{kind}, shard int, base long"))
    return placed.join(slots, ["cell", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).alias("slot"))
