"""Normalisation of contact tables: a lookup of each end's factor and one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_of


def _with_ends(contacts: DataFrame, factors: DataFrame, value: str) -> DataFrame:
    """factors: seq_id and value; adds x_i and x_j."""
    for x in ("i", "j"):
        contacts = contacts.join(factors.select(F.col("seq_id").alias(x), F.col(value).alias(f"x_{x}")), x)
    return contacts


def by_sites(contacts: DataFrame, sequences: DataFrame, value: str = "n") -> DataFrame:
    """value / (sites_i * sites_j); a sequence without sites counts as having one."""
    rows = _with_ends(contacts, sequences.select("seq_id", F.greatest("sites", F.lit(1)).alias("sites")), "sites")
    return rows.select("i", "j", (F.col(value) / (F.col("x_i").cast("double") * F.col("x_j"))).alias("value"))


def by_length(contacts: DataFrame, sequences: DataFrame, mean: str = "geometric", value: str = "n") -> DataFrame:
    """value / (mean of the lengths in thousands)."""
    rows = _with_ends(contacts, sequences, "length")
    return rows.select("i", "j", (F.col(value) / (1e-3 * mean_of(mean, "x_i", "x_j"))).alias("value"))


def tips_by_sites(tips: DataFrame, sequences: DataFrame, value: str = "n") -> DataFrame:
    """value / (sites of tip k of i * sites of tip l of j); sequences: tip_sites [left, right]."""
    rows = _with_ends(tips, sequences, "tip_sites")
    of = lambda x, tip: F.greatest(F.element_at(f"x_{x}", F.col(tip).cast("int") + 1), F.lit(1)).cast("double")
    return rows.select("i", "j", "k", "l", (F.col(value) / (of("i", "k") * of("j", "l"))).alias("value"))


def tips_by_length(tips: DataFrame, sequences: DataFrame, tip: int, value: str = "n") -> DataFrame:
    """value * tip^2 / (t_i * t_j), t being the shorter of length and tip."""
    rows = _with_ends(tips, sequences, "length")
    t = lambda x: F.least(F.col(f"x_{x}"), F.lit(tip)).cast("double")
    return rows.select("i", "j", "k", "l", (F.col(value) * float(tip) ** 2 / (t("i") * t("j"))).alias("value"))


def extents_by_length(extents: DataFrame, bins: DataFrame, sequences: DataFrame, mean: str = "geometric", value: str = "n") -> DataFrame:
    """Bin contacts over the mean length of the sequences that the bins belong to; bins: bin_id, seq_id."""
    lengths = bins.select("bin_id", "seq_id").join(sequences.select("seq_id", "length"), "seq_id")
    rows = extents
    for x in ("bi", "bj"):
        rows = rows.join(lengths.select(F.col("bin_id").alias(x), F.col("length").alias(f"_{x}")), x)
    return rows.select("bi", "bj", (F.col(value) / (1e-3 * mean_of(mean, "_bi", "_bj"))).alias("value"))


def scaled(contacts: DataFrame, scale: DataFrame, value: str = "value") -> DataFrame:
    """value * x_i * x_j; scale: seq_id, x.  Further key columns stay."""
    keys = [c for c in contacts.columns if c != value]
    rows = _with_ends(contacts, scale, "x")
    return rows.select(*keys, (F.col(value) * F.col("x_i") * F.col("x_j")).alias(value))
