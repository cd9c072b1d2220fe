"""Manifests that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.lineage import settled
from cairn.operators.matching import latest


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and users for each window of event time and type; events later than ``late`` are left out."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))


def first_slots(due: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (schedule_id, slot) once, however often it is offered within the watermark."""
    return due.withWatermark("slot", late).dropDuplicatesWithinWatermark(["schedule_id", "slot"])


#: Parts of the index; a batch rewrites only the parts that its paths fall into.
PARTS = 64


def keep_index(entries: DataFrame, path: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Fold entries (absolute_path, scan_generation, ...) into a Parquet index of the newest row for each path.

    The index is split by a hash of the path; a batch joins and replaces the parts it touches, and what it writes does
    not depend on how often it is tried.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("part", F.pmod(F.xxhash64("absolute_path"), F.lit(parts)).cast("int"))
        touched = [r.part for r in placed.select("part").distinct().collect()]  # at most ``parts`` rows
        held = placed
        if number:
            held = spark.read.parquet(path).filter(F.col("part").isin(touched)).unionByName(placed)
        newest = settled(latest(held, ["absolute_path"], [F.col("scan_generation").desc()]))
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return entries.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
