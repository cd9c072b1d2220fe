"""Reading the corpus tables, and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the folder the cluster names; a local one only where the session itself is local (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    checkpointing(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path of its own below the application's folder within the shared checkpoint folder."""
    checkpointing(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than keep all cores busy, or than a sixteenth of the shuffle's where that is more.

    For tables that are small beside what they are made of and whose order does not matter: on a local
    path each file costs several processes that set permissions, more than its rows do.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def settled_parquet(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder, in a folder of this application, and read again."""
    path = fresh_path(df.sparkSession, "stage")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


def vocabulary(name: str) -> str:
    """Where the installed vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
