"""Duplicate reports: JSON documents with groups of paths, read strictly."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "groups array<struct<file_len: long, size: long, file_hash: string, hash: string, files: array<string>, paths: array<string>>>"


def strict(text: str) -> None:
    """Raise ValueError for what a JSON reader may let pass: repeated keys, and anything after the document."""

    def unique(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    json.loads(text, object_pairs_hook=unique)


@F.pandas_udf(T.StringType())
def _checked(text: pd.Series) -> pd.Series:
    text.map(strict)
    return text


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """content_hash, size, paths of all groups in the report files; a malformed file or group fails the job."""
    whole = spark.read.text(path, wholetext=True).select(_checked("value").alias("value"))
    raw = whole.select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.groups")
    group = raw.select(F.explode("groups").alias("g"))
    rows = group.select(
        F.coalesce("g.file_hash", "g.hash").alias("content_hash"),
        F.coalesce("g.file_len", "g.size").alias("size"),
        F.coalesce("g.files", "g.paths").alias("paths"),
    )
    whole = F.col("content_hash").isNotNull() & F.col("size").isNotNull() & F.col("paths").isNotNull()
    return rows.withColumn("paths", F.when(whole, F.col("paths")).otherwise(F.raise_error(F.lit("a group lacks its hash, size or paths"))))


def members(groups: DataFrame, roots: list[str], reserved: str) -> DataFrame:
    """Paths of each group inside the roots and outside the reserved tree; groups left with fewer than two go."""
    from cairn.operators.matching import allowed

    each = groups.select("content_hash", "size", F.explode("paths").alias("path"))
    held = allowed(each, "path", roots, reserved)
    counted = held.groupBy("content_hash", "size").agg(F.count("*").alias("n")).filter("n >= 2")
    return held.join(counted.drop("n"), ["content_hash", "size"], "left_semi")
