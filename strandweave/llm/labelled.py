"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(id_).cast("string").cast("binary")), F.lit(folds)) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, keep: str = "true") -> DataFrame:
    """(label int, and the columns of docs) of up to `most` labelled documents outside the fold, by order of a hash of the id.

    Labels other than 0 and 1 and null ids are left out; of repeated labels of an id the smallest counts.  Half of the
    sample is kept for the rarer label as far as there are rows.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    rows = rows.where(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.withColumn("order", F.xxhash64("doc_id"))
    # each label's part is bounded, so the union may be broadcast
    parts = [rows.where(F.col("label") == v).orderBy("order", "doc_id").limit(most // 2) for v in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("labelled_id"), "label")
    return docs.join(F.broadcast(chosen), docs.doc_id == F.col("labelled_id")).drop("labelled_id")
