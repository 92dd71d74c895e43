"""Bins of about equal size over each sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bin_count, bin_edges
from ..functions.prefix import running_sum


def grouped_bins(sequences: DataFrame, size: int) -> DataFrame:
    """(seq_id, length, n_bins, edges, first_bin, end_bin) for each sequence; one without length is an error."""
    length = F.when(F.col("length") > 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("a sequence has no length: "), F.col("seq_id").cast("string"))).cast("long"))
    rows = sequences.select("seq_id", length.alias("length")).withColumn("n_bins", bin_count("length", size))
    rows = running_sum(rows, "seq_id", "n_bins", "first_bin").withColumn("first_bin", F.col("first_bin").cast("long"))
    return rows.withColumns({"edges": bin_edges("length", "n_bins"), "end_bin": F.col("first_bin") + F.col("n_bins")})


def bin_table(grouped: DataFrame) -> DataFrame:
    """(seq_id, bin_no, bin_id, lo, hi, center): a row for each bin; centres are relative to the sequence's middle and take the first bin's width."""
    rows = grouped.select("seq_id", "length", "edges", "first_bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin_no"))
    edge = lambda k: F.element_at("edges", k)
    width = edge(F.lit(2)) - edge(F.lit(1))
    rows = rows.withColumns({"lo": edge(F.col("bin_no") + 1), "hi": edge(F.col("bin_no") + 2), "_w": width})
    return rows.select("seq_id", "bin_no", (F.col("first_bin") + F.col("bin_no")).alias("bin_id"), "lo", "hi", (F.col("lo") + F.col("_w") / 2 - F.col("length") / 2).alias("center"))
