"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage like a checkpoint, survives lost executors, and has real sizes: an iteration that joins its own
last result would otherwise multiply estimated sizes round after round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import UnsupportedError


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name under spark.checkpoint.dir; where none is set, one in /tmp on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
            raise UnsupportedError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to a shared folder, and read."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
