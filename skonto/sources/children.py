"""Child rows of parents (aliases, IBANs, amounts): replaced as a whole, read nested.

The table is partitioned by a bucket of the parent's hash. A replacement reads and overwrites the buckets of its parents alone, so it costs
what these hold, not what the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skonto.sources.shared import written

BUCKETS = 64


def bucket(parent: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(parent.cast("bigint")), F.lit(buckets)).cast("int")


def different(rows: DataFrame, parent: str, value: str, norm: Column) -> DataFrame:
    """``rows`` without values that are empty or that their parent has already, compared as ``norm``; the first in order stays."""
    keyed = rows.withColumn("norm", norm).where("norm <> ''")
    return keyed.groupBy(parent, "norm").agg(F.min(value).alias(value))


def create_children(rows: DataFrame, path: str, parent: str, value: str, norm: Column, buckets: int = BUCKETS) -> None:
    """Write the child rows of all parents."""
    different(rows, parent, value, norm).withColumn("bucket", bucket(F.col(parent), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_children(path: str, parents: DataFrame, rows: DataFrame, parent: str, value: str, norm: Column, buckets: int = BUCKETS) -> None:
    """Give every parent of ``parents`` the child rows that ``rows`` has of it, which may be none; other parents keep theirs."""
    spark = parents.sparkSession
    touched = parents.select(parent).distinct().withColumn("bucket", bucket(F.col(parent), buckets))
    mine = [r.bucket for r in touched.select("bucket").distinct().collect()]  # no more than there are buckets
    if not mine:
        return
    table = spark.read.parquet(path)
    kept = table.where(F.col("bucket").isin(*mine)).join(touched.select(parent), parent, "left_anti")
    new = different(rows.join(touched.select(parent), parent, "left_semi"), parent, value, norm).withColumn("bucket", bucket(F.col(parent), buckets))
    # what is read is written elsewhere first, because the same buckets are overwritten
    both = written(kept.select(*table.columns).unionByName(new.select(*table.columns)), "children")
    emptied = [b for b in mine if b not in {r.bucket for r in both.select("bucket").distinct().collect()}]
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in emptied:  # a bucket that lost all of its rows has no partition that would overwrite it
        both.where("false").drop("bucket").write.mode("overwrite").parquet(f"{path}/bucket={b}")


def with_children(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """``parents`` with an array of values, in order, for each of ``children`` (a frame of the parent's key and a value); empty without any."""
    out = parents
    for name, rows in children.items():
        value = next(c for c in rows.columns if c != key)
        nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
        out = out.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out
