"""Where results are written: previews, plans, frozen manifests, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_preview(rows: DataFrame, path: str) -> None:
    """JSON lines, one file for each partition."""
    rows.write.mode("overwrite").json(path)


def write_plan(items: DataFrame, path: str) -> None:
    """Plan rows by plan_id; a plan written again replaces its own rows only."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plan_id").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """rows and checksum of a table, whatever the order of its rows: the sum of two 64-bit hashes of each."""
    columns = sorted(rows.columns)
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("rows"), F.concat_ws(":", total(1), total(2)).alias("checksum"))


def freeze(rows: DataFrame, path: str) -> None:
    """The rows below ``path``/rows and their digest below ``path``/digest; a manifest is never written twice."""
    rows.write.mode("error").parquet(f"{path}/rows")
    digest(rows.sparkSession.read.parquet(f"{path}/rows")).write.mode("error").parquet(f"{path}/digest")


def thawed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a frozen manifest, if they still have its digest."""
    rows = spark.read.parquet(f"{path}/rows")
    if digest(rows).first() != spark.read.parquet(f"{path}/digest").first():  # one row each
        raise ValueError(f"the manifest was changed: {path}")
    return rows


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; text that a spreadsheet would run as a formula gets an apostrophe before it."""
    guard = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(F.col(c)).alias(c)
    texts = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    rows.select(*(guard(c) if c in texts else F.col(c) for c in rows.columns)).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
