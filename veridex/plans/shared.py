"""The folder that all executors and the driver share, and small tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session gets a folder of its own where none is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veridex-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in that folder: worked out once, and safe from lost executors. For results that several steps read and that
    are small beside their inputs; the folder's owner clears it after the session."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
