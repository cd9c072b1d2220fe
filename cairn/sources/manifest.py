"""Manifest views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import basename, stem, suffix

EXTENSIONS = ["jpg", "mp4", "txt", "PDF", "zip", "mp3", "dat"]
ROOTS = [f"/data/r{i}" for i in range(4)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files; the content hash is only computed where a query uses it."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    relative = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    root = F.concat(F.lit("/data/r"), (F.col("doc_id") % len(ROOTS)).cast("string"))
    out = docs.select(F.col("doc_id").alias("id"), root.alias("root_key"), relative.alias("relative_path"), "text", "lang", "source")
    return described(out).select(
        "*",
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("content_hash"),
        mtime(F.col("id")).alias("mtime_ns"),
        F.lit(1).alias("device"),
        F.col("id").alias("inode"),
        F.lit(False).alias("is_dir"),
    ).drop("text")


def mtime(number: Column) -> Column:
    return F.lit(1_700_000_000_000_000_000) + (number * 7919 % 1_000_003) * 1_000_000_000


def described(rows: DataFrame) -> DataFrame:
    """Rows with the names that follow from root_key and relative_path."""
    named = rows.withColumn("basename", basename(F.col("relative_path")))
    named = named.withColumn("suffix", suffix(F.col("basename"))).withColumn("stem", stem(F.col("basename")))
    return named.withColumn("absolute_path", F.concat("root_key", F.lit("/"), "relative_path"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as package files: package, name, kind, bytes."""
    items = table(spark, sf_dir, "lineitem")
    year = F.date_format("l_shipdate", "yy")
    daily = F.concat(F.date_format("l_shipdate", "yyMM"), F.lit("/"), F.date_format("l_shipdate", "yyMMdd"), F.lit("/"), F.col("l_suppkey").cast("string"))
    package = F.when(F.col("l_suppkey") % 3 == 0, daily).otherwise(F.concat(year, F.lit("01/"), year, F.lit("0101/all")))  # small and large ones
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ext = F.element_at(F.array(F.lit("jpg"), F.lit("mp4"), F.lit("txt"), F.lit("png")), (key % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("P"), F.lit("V"), F.lit("Other"), F.lit("P")), (key % 4 + 1).cast("int"))
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("."), ext)
    return items.select(package.alias("package"), name.alias("name"), kind.alias("kind"), (F.floor("l_extendedprice") * F.pow(F.col("l_linenumber") * F.col("l_linenumber") * 9, F.col("l_linenumber") % 4)).cast("long").alias("bytes"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as media assets of the documents: integrity and verification state."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").alias("indexed_path_id"),
        F.when(F.col("quality") == 1, "healthy").otherwise("corrupt").alias("integrity_status"),
        F.when(F.col("toxic") == 1, "changed").otherwise("verified").alias("verification_status"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as an operation journal."""
    rows = table(spark, sf_dir, "conversations")
    operation = F.when(F.col("role") == "user", "rename").when(F.col("role") == "assistant", "quarantine").otherwise("move")
    at = lambda place: F.concat(F.lit(f"/{place}/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return rows.select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("sequence"), operation.alias("operation"), at("a").alias("source"), at("b").alias("target"))
