"""Incremental ingest: counts are sums, so each micro-batch of complete name groups adds to a table of contacts.

Batches are written under their own number and a batch that is retried overwrites itself, so totals count each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MapConfig
from ..operators.contacts import classified, counted, informative, paired


def ingest(stream: DataFrame, sequences: DataFrame, config: MapConfig, order: list[str], folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds the contacts of a stream of alignments to a folder; files must hold whole name groups."""

    def add(batch: DataFrame, number: int) -> None:
        rows = counted(classified(paired(informative(batch), order), sequences, config))
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def contacts(spark, folder: str) -> DataFrame:
    """The sum over all batches so far."""
    return spark.read.parquet(folder).groupBy("i", "j").agg(F.sum("n").alias("n"))
