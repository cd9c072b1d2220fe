"""Reports kept as files of JSON lines or JSON arrays, and pages of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.lifecycle import listed


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of the one array in each file; a file that is no array fails the job."""
    whole = spark.read.text(path, wholetext=True)
    wanted = T.ArrayType(T._parse_datatype_string(schema))
    items = whole.select(F.from_json("value", wanted, {"mode": "FAILFAST"}).alias("items"), F.trim("value").startswith("[").alias("is_array"))
    checked = F.when(F.col("is_array"), F.col("items")).otherwise(F.raise_error(F.lit("the file holds no array")).cast(wanted))
    return items.select(F.explode(checked).alias("item")).select("item.*")


def page(rows: DataFrame, order: str, number: int, size: int, status: str | None = None, only: tuple[str, str] | None = None) -> DataFrame:
    """A page in the order of one column, of rows with a status, or with a value in one column, where these are given."""
    where = F.lit(True)
    if status is not None:
        where &= F.col("status") == status
    if only is not None:
        where &= F.col(only[0]) == only[1]
    return listed(rows, [F.col(order)], number, size, where)
