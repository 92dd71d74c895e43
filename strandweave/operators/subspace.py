"""Reductions and rearrangements of contact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marginalised(tips: DataFrame, value: str = "n") -> DataFrame:
    """Tips added up: (i, j, value)."""
    return tips.groupBy("i", "j").agg(F.sum(value).alias(value))


def flattened(tips: DataFrame, value: str = "n") -> DataFrame:
    """Tip cells as cells of a map of twice the size: (2i + k, 2j + l)."""
    return tips.select((2 * F.col("i") + F.col("k")).alias("i"), (2 * F.col("j") + F.col("l")).alias("j"), value)


def doubled_order(order: DataFrame) -> DataFrame:
    """(id, rank) of single ids to that of tip ids: o becomes 2o, 2o + 1."""
    rows = order.select("rank", F.posexplode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("_k", "id"))
    return rows.select("id", (2 * F.col("rank") + F.col("_k")).alias("rank"))


def permuted(contacts: DataFrame, order: DataFrame, i: str = "i", j: str = "j", full: bool = True) -> DataFrame:
    """Cells under new indices; order: id, rank.  full: both triangles are given; else the result is the upper triangle again."""
    names = contacts.columns
    for x in (i, j):
        at = order.select(F.col("id").alias(x), F.col("rank").alias("_rank"))
        contacts = contacts.join(at, x).drop(x).withColumnRenamed("_rank", x)
    if not full:
        contacts = contacts.withColumns({i: F.least(i, j), j: F.greatest(i, j)})
    return contacts.select(names)


def bin_order(grouped: DataFrame, order: DataFrame) -> DataFrame:
    """(id, rank) of bins for sequences in an order (seq_id, rank, ori): the bins of a reversed sequence run backwards."""
    from ..functions.prefix import running_sum

    rows = grouped.select("seq_id", "first_bin", "n_bins").join(order, "seq_id")
    rows = running_sum(rows, "rank", "n_bins", "_base")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("_k"))
    at = F.when(F.col("ori") < 0, F.col("n_bins") - 1 - F.col("_k")).otherwise(F.col("_k"))
    return rows.select((F.col("first_bin") + F.col("_k")).alias("id"), (F.col("_base") + at).alias("rank"))


def downsampled(contacts: DataFrame, block: int, method: str = "mean", value: str = "n") -> DataFrame:
    """Blocks of a full map: the sum over block^2 (what is beyond the edge counts as zero) or the largest value."""
    if block < 2:
        raise ValueError("a block is a whole number above 1")
    groups = contacts.groupBy(F.floor(F.col("i") / block).cast("int").alias("i"), F.floor(F.col("j") / block).cast("int").alias("j"))
    if method == "mean":
        return groups.agg((F.sum(value) / float(block * block)).alias("value"))
    if method == "max":
        return groups.agg(F.max(value).cast("double").alias("value"))
    raise ValueError(f"{method}: the methods are mean and max")


def extents_to_sequences(extents: DataFrame, bins: DataFrame, legacy: bool = False, value: str = "n") -> DataFrame:
    """Upper-triangle bin contacts added up by sequence pair: (i, j, value) with i <= j; bins: bin_id, seq_id.

    The diagonal adds each unordered bin pair once.  legacy: the diagonal is what block sums over the symmetric map give that
    start each row at column 0: off-diagonal cells within a sequence count twice, and contacts with all earlier sequences are added.
    """
    rows = extents
    for x, s in (("bi", "i"), ("bj", "j")):
        rows = rows.join(bins.select(F.col("bin_id").alias(x), F.col("seq_id").alias(s)), x)
    total = rows.groupBy("i", "j").agg(F.sum(value).alias(value), F.sum(F.when(F.col("bi") != F.col("bj"), F.col(value)).otherwise(0)).alias("_twice"))
    if not legacy:
        return total.select("i", "j", value)
    earlier = total.where("i <> j").groupBy(F.col("j").alias("_s")).agg(F.sum(value).alias("_before"))
    touched = total.select("i", "j", value, "_twice").unionByName(earlier.select(F.col("_s").alias("i"), F.col("_s").alias("j"), F.lit(0).alias(value), F.lit(0).alias("_twice")))
    touched = touched.groupBy("i", "j").agg(F.sum(value).alias(value), F.sum("_twice").alias("_twice"))
    rows = touched.join(earlier, F.col("i") == F.col("_s"), "left")
    same = F.col("i") == F.col("j")
    return rows.select("i", "j", (F.col(value) + F.when(same, F.col("_twice") + F.coalesce("_before", F.lit(0))).otherwise(0)).alias(value))


def heatmap_table(contacts: DataFrame, order: DataFrame | None = None, alpha: float = 1.0, simple: bool = True, zero_diag: bool | None = None, block: int | None = None, pattern_only: bool = False, value: str = "value") -> DataFrame:
    """(row, col, value): ln(value + alpha) of the non-zero cells of a full map, a hundredfold first if it is a simple map; 1 for each cell with pattern_only.

    zero_diag: None takes the diagonal out of simple maps only.  block: cells are averaged first.
    """
    if order is not None:
        contacts = permuted(contacts, order)
    if zero_diag or zero_diag is None and simple:
        contacts = contacts.where("i <> j")
    if block:
        contacts = downsampled(contacts, block, "mean", value).withColumnRenamed("value", value)
    shown = F.lit(1.0) if pattern_only else F.ln(F.col(value) * (100.0 if simple else 1.0) + alpha)
    return contacts.where(F.col(value) != 0).select(F.col("i").alias("row"), F.col("j").alias("col"), shown.alias("value"))


def tick_labels(order: DataFrame, sequences: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """(rank, label, location): signed names and the running count of rows (or bins) before each; order: seq_id, rank, ori; widths: seq_id, n_bins."""
    from ..functions.prefix import running_sum

    rows = order.join(sequences.select("seq_id", "name"), "seq_id")
    rows = rows.join(widths.select("seq_id", F.col("n_bins").cast("long").alias("_w")), "seq_id") if widths is not None else rows.withColumn("_w", F.lit(1).cast("long"))
    rows = running_sum(rows, "rank", "_w", "location")
    sign = F.when(F.col("ori") < 0, F.lit("- ")).otherwise(F.lit("+ "))
    return rows.select("rank", F.concat(sign, "name").alias("label"), "location")


def cluster_boundaries(members: DataFrame, widths: DataFrame | None = None, flatten: bool = False) -> DataFrame:
    """(cl_id, size, end): rows (or bins) of each cluster and the running count to its end; twice as many in a flattened map."""
    from ..functions.prefix import running_sum

    rows = members.join(widths.select("seq_id", F.col("n_bins").alias("_w")), "seq_id") if widths is not None else members.withColumn("_w", F.lit(1))
    size = rows.groupBy("cl_id").agg((F.sum("_w") * (2 if flatten else 1)).alias("size"))
    rows = running_sum(size, "cl_id", "size", "_before")
    return rows.select("cl_id", "size", (F.col("_before") + F.col("size")).alias("end"))
