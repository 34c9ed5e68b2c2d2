"""Documents as files: import without copies, table dumps, and reports as CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that documents may have, and the largest size in bytes.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "txt")
LARGEST = 50 * 1024 * 1024


def import_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(sha256, path, size, content) of permitted files below a folder; equal contents once, known hashes not at all."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fit = raw.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$") & (F.col("length") <= LARGEST) & (F.col("length") > 0))
    hashed = fit.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("size"), "content")
    first = hashed.groupBy("sha256").agg(F.min("path").alias("path"))
    once = hashed.join(first, ["sha256", "path"], "left_semi")
    return once if known is None else once.join(known.select("sha256"), "sha256", "left_anti")


def dump(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write tables as JSON lines, binaries as base64."""
    for name, df in tables.items():
        df.select(*[F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Read tables that ``dump`` wrote, by their DDL schemas."""
    out = {}
    for name, ddl in schemas.items():
        empty = spark.createDataFrame([], ddl)
        text = spark.createDataFrame([], ", ".join(f"`{c}` {'string' if t == 'binary' else t}" for c, t in empty.dtypes)).schema
        df = spark.read.schema(text).json(f"{folder}/{name}")
        out[name] = df.select(*[F.unbase64(c).alias(c) if t == "binary" else F.col(c) for c, t in empty.dtypes])
    return out


def report_lines(df: DataFrame, title: str, subtitle: str, order: Sequence[str], money: Sequence[str] = (), totals: Sequence[str] = (), total_label: str = "Summe") -> DataFrame:
    """(place, line): a report as lines of a CSV file with semicolons, as spreadsheets with German settings read it.

    Title, subtitle and column names come first, behind a byte order mark; cents in ``money`` are written as 1.234,56 and days as
    dd.mm.yyyy; sums of ``totals`` come last. Values that hold a semicolon, a quote or a line break are quoted; null is empty.
    """
    from skonto.functions.money import format_cents

    spark, names = df.sparkSession, df.columns
    day = {f.name for f in df.schema.fields if f.dataType.typeName() == "date"}
    plain = lambda c: format_cents(F.col(c), symbol=False) if c in money else F.date_format(c, "dd.MM.yyyy") if c in day else F.col(c).cast("string")
    quoted = lambda v: F.when(v.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    joined = lambda values: F.concat_ws(";", *[F.coalesce(v, F.lit("")) for v in values])
    head = F.array(*[F.struct(F.lit(k).alias("place"), line.alias("line")) for k, line in enumerate((F.concat(F.lit("\ufeff"), quoted(F.lit(title))), quoted(F.lit(subtitle)), joined([quoted(F.lit(c)) for c in names])))])
    first = spark.range(1).select(F.inline(head))
    rows = df.select(F.lit(3).alias("place"), F.struct(*order).alias("order"), joined([quoted(plain(c)) for c in names]).alias("line"))
    out = first.withColumn("order", F.lit(None).cast(rows.schema["order"].dataType)).select("place", "order", "line").unionByName(rows)
    if totals:
        sums = df.agg(*[F.sum(c).alias(c) for c in totals])
        last = joined([F.coalesce(plain(c), F.lit("0")) if c in totals else F.lit(total_label if k == 0 else "") for k, c in enumerate(names)])
        out = out.unionByName(sums.select(F.lit(4).alias("place"), F.lit(None).cast(rows.schema["order"].dataType).alias("order"), last.alias("line")))
    return out.orderBy("place", "order").select("place", "line")


def write_report(df: DataFrame, path: str, order: Sequence[str], title: str = "", subtitle: str = "", money: Sequence[str] = (), totals: Sequence[str] = ()) -> None:
    """A report as one CSV file: a report is small, its rows are put in order first."""
    report_lines(df, title, subtitle, order, money, totals).select("line").coalesce(1).write.mode("overwrite").text(path)


def append_entries(entries: DataFrame, path: str) -> None:
    """Append ledger entries; the write fails on an entry that breaks the rules on signs, before anything is added."""
    from skonto.operators.planners import sign_violations

    if sign_violations(entries).limit(1).count():
        raise ValueError("entries break the rules on signs")
    entries.write.mode("append").parquet(path)
