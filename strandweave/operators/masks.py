"""Acceptance of sequences, and maps restricted to the accepted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoneAcceptedError, UnsupportedError
from ..functions.prefix import dense_ids


def max_off_diagonal(contacts: DataFrame, sequences: DataFrame, value: str = "n") -> DataFrame:
    """(seq_id, signal): the largest value with another sequence, 0 if there is none.  contacts: upper triangle."""
    off = contacts.where("i <> j").select(F.explode(F.array("i", "j")).alias("seq_id"), value)
    best = off.groupBy("seq_id").agg(F.max(value).alias("signal"))
    return sequences.select("seq_id").join(best, "seq_id", "left").select("seq_id", F.coalesce("signal", F.lit(0)).alias("signal"))


def max_off_diagonal_tips(tips: DataFrame, sequences: DataFrame) -> DataFrame:
    """The same over tips added up."""
    return max_off_diagonal(tips.groupBy("i", "j").agg(F.sum("n").alias("n")), sequences)


def acceptance(sequences: DataFrame, signal: DataFrame, min_len: int, min_signal: float, max_fold: float | None = None) -> DataFrame:
    """(seq_id, length, signal, accepted)."""
    if max_fold is not None:
        raise UnsupportedError("masking by fold isn't offered")
    rows = sequences.select("seq_id", "length").join(signal, "seq_id")
    return rows.withColumn("accepted", (F.col("length") >= min_len) & (F.col("signal") >= min_signal))


def accepted_ids(mask: DataFrame, check: bool = False) -> DataFrame:
    """(seq_id, dense_id) of accepted sequences: ids without gaps, in order."""
    kept = mask.where("accepted").select("seq_id")
    if check and kept.isEmpty():
        raise NoneAcceptedError("no sequence was accepted")
    return dense_ids(kept, "seq_id", "dense_id")


def intersected(mask: DataFrame, other: DataFrame) -> DataFrame:
    """The mask and another one (seq_id, accepted); a sequence that the other lacks isn't accepted."""
    o = other.select("seq_id", F.col("accepted").alias("_other"))
    return mask.join(o, "seq_id", "left").withColumn("accepted", F.col("accepted") & F.coalesce("_other", F.lit(False))).drop("_other")


def restricted(contacts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cells with both ends accepted, ids as they were."""
    ids = accepted.select("seq_id")
    for x in ("i", "j"):
        contacts = contacts.join(ids.withColumnRenamed("seq_id", x), x, "left_semi")
    return contacts


def compressed(contacts: DataFrame, accepted: DataFrame) -> DataFrame:
    """Cells with both ends accepted, under dense ids; further key columns (tips) stay."""
    names = contacts.columns
    for x in ("i", "j"):
        ids = accepted.select(F.col("seq_id").alias(x), F.col("dense_id").alias(f"_{x}"))
        contacts = contacts.join(ids, x).drop(x).withColumnRenamed(f"_{x}", x)
    return contacts.select(names)


def expanded(rows: DataFrame, accepted: DataFrame, column: str = "dense_id") -> DataFrame:
    """Dense ids put back to sequence ids."""
    ids = accepted.select(F.col("dense_id").alias(column), "seq_id")
    return rows.join(ids, column).drop(column)


def dense_bins(grouped: DataFrame, accepted: DataFrame) -> DataFrame:
    """(bin_id, dense_bin, seq_id) of the accepted sequences' bins."""
    own = grouped.join(accepted.select("seq_id"), "seq_id", "left_semi")
    rows = own.select("seq_id", F.explode(F.sequence("first_bin", F.col("end_bin") - 1)).alias("bin_id"))
    return dense_ids(rows, "bin_id", "dense_bin")


def compressed_extents(extents: DataFrame, bins: DataFrame) -> DataFrame:
    """Bin contacts of accepted sequences under dense bin ids; bins: of dense_bins()."""
    names = extents.columns
    for x in ("bi", "bj"):
        ids = bins.select(F.col("bin_id").alias(x), F.col("dense_bin").alias(f"_{x}"))
        extents = extents.join(ids, x).drop(x).withColumnRenamed(f"_{x}", x)
    return extents.select(names)


def is_hermitian(full: DataFrame, tolerance: float = 1e-6, value: str = "n") -> bool:
    """Whether no cell of a full map differs from its mirror by the tolerance or more."""
    a, b = full.select("i", "j", F.col(value).alias("x")), full.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("y"))
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return a.join(b, ["i", "j"], "full").where(gap >= tolerance).isEmpty()


def without_diagonal(contacts: DataFrame) -> DataFrame:
    return contacts.where("i <> j")
