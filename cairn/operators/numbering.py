"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.lineage import settled


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with numbers from 0 in ``order``, which must not have ties.

    Rows are sorted by ranges over all partitions and written once; the sizes of the partitions, one row each, give
    every partition its first number.
    """
    spark = rows.sparkSession
    sorted_ = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    starts, total = [], 0
    for part, n in placed.groupBy("__part").count().orderBy("__part").collect():  # one row for each partition
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def numbered_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """The same from 0 within each group ``by``; a group may be spread over any number of tasks."""
    placed = numbered(rows, [*map(F.col, by), *order], name)
    if not by:
        return placed
    starts = placed.groupBy(*by).agg(F.min(name).alias("__first"))
    return placed.join(starts, by).withColumn(name, F.col(name) - F.col("__first")).drop("__first")
