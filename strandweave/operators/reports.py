"""Cluster tables and per-cluster reports.

clusters: (cl_id, name, extent, size); members: (cl_id, seq_id[, membership]); cluster order: (cl_id, rank, seq_id, ori).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NoRemainingClustersError, NoReportError
from ..functions.numeric import _c
from ..functions.prefix import ranked
from ..functions.sequence import gc_percent
from .order_state import with_mask, with_order


def ranked_clusters(members: DataFrame, sequences: DataFrame, prefix: str = "CL") -> tuple[DataFrame, DataFrame]:
    """(clusters, members): clusters numbered from 0 by descending extent, ties by the id that they had."""
    sizes = members.join(sequences.select("seq_id", "length"), "seq_id").groupBy("cl_id").agg(F.sum("length").alias("extent"), F.count("*").alias("size"))
    new = ranked(sizes, [("extent", False), ("cl_id", True)], "_new").withColumn("_new", F.col("_new").cast("int"))
    clusters = named(new.select(F.col("_new").alias("cl_id"), "extent", "size"), prefix)
    rest = [c for c in members.columns if c != "cl_id"]
    return clusters, members.join(new.select("cl_id", "_new"), "cl_id").select(F.col("_new").alias("cl_id"), *rest)


def named(clusters: DataFrame, prefix: str = "CL") -> DataFrame:
    """Adds name: the prefix and the number from 1, padded to the width of the largest id from 0 (so ten clusters give CL1 to CL10)."""
    top = clusters.agg(F.max("cl_id").alias("_top"))  # one row
    width = F.greatest(F.lit(1), F.ceil(F.log10(F.col("_top") + 1.0))).cast("int")
    number = (F.col("cl_id") + 1).cast("string")
    name = F.concat(F.lit(prefix), F.lpad(number, F.greatest(width, F.length(number)), F.lit("0")))
    return clusters.crossJoin(F.broadcast(top)).withColumn("name", name).drop("_top")


def member_report(members: DataFrame, sequences: DataFrame, fasta: DataFrame, coverage: Callable[[Column], Column] | None = None, coverage_field: str = "id") -> DataFrame:
    """(cl_id, seq_id, length, gc, cov): fasta is (id, description, seq), id being the sequence's name; cov is null without a coverage function."""
    rows = members.join(sequences.select("seq_id", "name", "length"), "seq_id").join(fasta, F.col("name") == fasta["id"])
    cov = coverage(F.col(coverage_field)) if coverage else F.lit(None)
    return rows.select("cl_id", "seq_id", "length", gc_percent("seq").alias("gc"), cov.cast("double").alias("cov"))


def n50(rows: DataFrame, by: list[str], value: str = "length") -> DataFrame:
    """(by..., n50): the largest value whose running sum over descending values exceeds half the total, rounded down."""
    w = Window.partitionBy(*by)
    run = F.sum(value).over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*by, value, run.alias("_run"), F.sum(value).over(w).alias("_total"))
    return rows.where(F.col("_run") > F.floor(F.col("_total") / 2)).groupBy(*by).agg(F.max(value).alias("n50"))


def expectation(weight: Column | str, x: Column | str) -> Column:
    return F.sum(_c(weight) * _c(x)) / F.sum(_c(weight))


def cluster_report(report: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row for each cluster: id, name, size, extent, n50, and expectation by length, mean, median and population deviation of gc and cov."""
    if report is None:
        raise NoReportError("make the member report first")
    parts = []
    for x in ("gc", "cov"):
        parts += [expectation("length", x).alias(f"{x}_expect"), F.avg(x).alias(f"{x}_mean"), F.median(x).alias(f"{x}_median"), F.stddev_pop(x).alias(f"{x}_std")]
    stats = report.groupBy("cl_id").agg(*parts).join(n50(report, ["cl_id"]), "cl_id")
    head = clusters.select("cl_id", "name", "size", "extent").join(stats, "cl_id")
    tail = [f"{x}_{k}" for x in ("gc", "cov") for k in ("expect", "mean", "median", "std")]
    return head.select(F.col("cl_id").alias("id"), "name", "size", "extent", "n50", *tail)


def lost_sequences(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """Sequences in no cluster."""
    return sequences.join(members.select("seq_id"), "seq_id", "left_anti")


def mcl_lines(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """(cl_id, line): names of each cluster's members by id; what is in no cluster follows, a line each, with a null cl_id."""
    named_ = members.join(sequences.select("seq_id", "name"), "seq_id")
    lines = named_.groupBy("cl_id").agg(F.array_sort(F.collect_list(F.struct("seq_id", "name"))).alias("_m"))
    lines = lines.select("cl_id", F.array_join(F.transform("_m", lambda m: m["name"]), " ").alias("line"))
    alone = lost_sequences(sequences, members).select(F.lit(None).cast(lines.schema["cl_id"].dataType).alias("cl_id"), F.col("name").alias("line"))
    return lines.unionByName(alone)


def numbered_members(members: DataFrame, cluster_order: DataFrame | None = None) -> DataFrame:
    """(cl_id, n, seq_id, ori): members from 1 by id with no orientation, or in their cluster's order with one."""
    if cluster_order is None:
        w = Window.partitionBy("cl_id").orderBy("seq_id")
        return members.select("cl_id", F.row_number().over(w).alias("n"), "seq_id", F.lit(None).cast("byte").alias("ori"))
    w = Window.partitionBy("cl_id").orderBy("rank")
    return cluster_order.select("cl_id", F.row_number().over(w).alias("n"), "seq_id", "ori")


def eligible(clusters: DataFrame, min_extent: int = 0, min_size: int = 0) -> DataFrame:
    return clusters.where((F.col("extent") >= min_extent) & (F.col("size") >= min_size))


def enabled_clusters(state: DataFrame, clusters: DataFrame, cluster_order: DataFrame, members: DataFrame, chosen: list[int] | None = None, ordered_only: bool = True, min_extent: int = 0) -> DataFrame:
    """The order state with the clusters' members accepted, in cluster order: ascending ids, each cluster in its own order.

    Of a cluster without an order, members follow by id unless ordered_only leaves it out; members that the state already masks stay masked.
    """
    kept = clusters.where(F.col("extent") >= min_extent).select("cl_id")
    if chosen is not None:
        kept = kept.where(F.col("cl_id").isin(chosen))
    own = cluster_order.select("cl_id", "rank", "seq_id", F.col("ori").cast("int").alias("ori"))
    if not ordered_only:
        rest = members.join(cluster_order.select("cl_id").distinct(), "cl_id", "left_anti")
        own = own.unionByName(rest.select("cl_id", F.col("seq_id").alias("rank"), "seq_id", F.lit(1).alias("ori")))
    rows = own.join(kept, "cl_id", "left_semi").join(state.where("mask").select("seq_id"), "seq_id", "left_semi")
    if rows.isEmpty():
        raise NoRemainingClustersError("no cluster is left")
    order = ranked(rows.select("seq_id", "ori", "cl_id", F.col("rank").alias("_own")), [("cl_id", True), ("_own", True)], "rank").select("seq_id", "ori", "rank")
    mask = state.select("seq_id").join(order.select("seq_id", F.lit(True).alias("_in")), "seq_id", "left").select("seq_id", F.coalesce("_in", F.lit(False)).alias("accepted"))
    return with_order(with_mask(state, mask), order, implicit_excluded=True)
