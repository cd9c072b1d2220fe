"""A corpus run from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import line_dedup, minhash, packing, quality, suffix_dedup
from cairn.llm.tables import settled_parquet, vocabulary


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is such a column, brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines."""
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches."""
    return _sized(line_dedup.cleaned(docs))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("id"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"))
    return packed.join(kept, F.col("own").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes under repeated passages."""
    return _sized(suffix_dedup.remaining(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they lie in."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", minhash_stage),
    ("suffix-array dedup", suffix_array_stage),
    ("packing", packing_stage),
]

#: Suffix sorting and packing are beyond SQL; the whole run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled_parquet(docs)
    return docs
