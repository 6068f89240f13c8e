"""Tables written to the folder that driver and executors share, which cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder. Where neither is set, a folder of our own, and only if the
    session runs on this machine alone: on a cluster other machines don't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again. The planner then knows its exact size, and joins small tables without
    a shuffle."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
