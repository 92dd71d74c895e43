"""Weighted graphs of contacts: edges (src, dst, weight) with src <= dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import ranked
from ..tables import written


def edge_graph(contacts: DataFrame, scale: bool = True, drop_self_loops: bool = False, value: str = "value") -> DataFrame:
    """Upper-triangle cells as edges, over the largest weight with scale; self loops stay unless dropped."""
    edges = contacts.where(f"i <= j and {value} <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col(value).cast("double").alias("weight"))
    if drop_self_loops:
        edges = edges.where("src <> dst")
    if scale:
        top = edges.agg(F.max("weight").alias("_top"))  # one row
        edges = edges.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.col("_top")).alias("weight"))
    return edges


def named_edges(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """Edges between names."""
    for x in ("src", "dst"):
        edges = edges.join(sequences.select(F.col("seq_id").alias(x), F.col("name").alias(f"_{x}")), x)
    return edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, weight): each edge from both ends, a self loop once."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))


def graph_info(edges: DataFrame) -> DataFrame:
    """(nodes, edges)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("u")).agg(F.countDistinct("u").alias("nodes"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("edges")))


def inverted_weights(edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Weights w as 1 / (w + alpha); twice isn't the identity."""
    return edges.withColumn("weight", 1 / (F.col("weight") + alpha))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (u) with no edge to another node."""
    touched = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("u"))
    return nodes.join(touched, "u", "left_anti")


def with_isolates(partition: DataFrame, nodes: DataFrame, edges: DataFrame, mode: str = "keep") -> DataFrame:
    """partition (node, cl_id) of a graph: isolates stay ("keep"), go ("drop"), or make one more cluster ("ragbag")."""
    if mode == "keep":
        return partition
    alone = isolates(nodes, edges).withColumnRenamed("u", "node")
    rest = partition.join(alone, "node", "left_anti")
    if mode == "drop":
        return rest
    if mode == "ragbag":
        top = rest.agg((F.coalesce(F.max("cl_id"), F.lit(-1)) + 1).alias("cl_id"))
        return rest.select("node", "cl_id").unionByName(alone.crossJoin(F.broadcast(top)).select("node", "cl_id"))
    raise ValueError(f"{mode}: the modes are keep, drop and ragbag")


def _with_parts(edges: DataFrame, partition: DataFrame) -> DataFrame:
    for x in ("src", "dst"):
        edges = edges.join(partition.select(F.col("node").alias(x), F.col("cl_id").alias(f"p_{x}")), x)
    return edges


def subgraphs(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(cl_id, src, dst, weight): edges within a part."""
    rows = _with_parts(edges, partition).where("p_src = p_dst")
    return rows.select(F.col("p_src").alias("cl_id"), "src", "dst", "weight")


def inter_partition_weights(edges: DataFrame, partition: DataFrame, mean: bool = True, value: str = "weight") -> DataFrame:
    """(p, q, weight): mean (or sum) of the weights of edges between parts p < q."""
    rows = _with_parts(edges, partition).where("p_src <> p_dst")
    return rows.groupBy(F.least("p_src", "p_dst").alias("p"), F.greatest("p_src", "p_dst").alias("q")).agg((F.avg if mean else F.sum)(value).alias("weight"))


def soft_membership(edges: DataFrame, partition: DataFrame, method: str = "hard") -> DataFrame:
    """(node, cl_id, membership): whole members of their part, and with "simple" half members of the parts that an edge leads to;
    with "maxaff" only if the edge is the node's heaviest."""
    rows = partition.select("node", "cl_id", F.lit(1.0).alias("membership"))
    if method == "hard":
        return rows
    if method not in ("simple", "maxaff"):
        raise ValueError(f"{method}: the methods are hard, simple and maxaff")
    ends = both_ways(edges)
    if method == "maxaff":
        ends = ends.withColumn("_top", F.max("weight").over(Window.partitionBy("u"))).where("weight = _top").drop("_top")
    for x in ("u", "v"):
        ends = ends.join(partition.select(F.col("node").alias(x), F.col("cl_id").alias(f"p_{x}")), x)
    cross = ends.where("p_u <> p_v").select(F.col("u").alias("node"), F.col("p_v").alias("cl_id")).distinct()
    return rows.unionByName(cross.withColumn("membership", F.lit(0.5)))


def nearest(edges: DataFrame, n: int) -> DataFrame:
    """(u, v): each node's n + 1 heaviest neighbours, ties by id; a self loop may take a place."""
    w = Window.partitionBy("u").orderBy(F.desc("weight"), "v")
    return both_ways(edges).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n + 1).select("u", "v")


def local_sets(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(u, v): nodes reached by k steps at most along nearest neighbours; a node may be in its own set."""
    step = nearest(edges, n)
    reach = front = step
    for _ in range(k - 1):
        front = front.alias("a").join(step.alias("b"), F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.v").alias("v")).distinct()
        reach = reach.union(front).distinct()
    return reach


def geometric_mean(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.exp(F.avg(F.ln(x)))


def degenerates(edges: DataFrame, nodes: DataFrame, fold_max: float, min_len: int = 0, n: int = 5, k: int = 2) -> DataFrame:
    """(node, length, coverage, local, fold, degenerate): coverage over the geometric mean of the node's local set; nodes: node, length, coverage.

    Nodes shorter than min_len and nodes without an edge are left out; neighbours aren't.
    """
    sets = local_sets(edges, n, k)
    near = nodes.select(F.col("node").alias("v"), F.col("coverage").alias("_c"))
    local = sets.join(near, "v").groupBy(F.col("u").alias("node")).agg(geometric_mean("_c").alias("local"))
    rows = nodes.where(F.col("length") >= min_len).join(local, "node").withColumn("fold", F.col("coverage") / F.col("local"))
    return rows.select("node", "length", "coverage", "local", "fold", (F.col("fold") > fold_max).alias("degenerate"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, by rounds of least neighbours with shortcuts, each written."""
    links = written(both_ways(edges).select("u", "v").distinct())
    label = written(links.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = links.join(label.select(F.col("node").alias("v"), F.col("component").alias("_c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("_c").alias("_c"))
        hooked = label.join(near, "node").select("node", F.least("component", "_c").alias("component"))
        # a label's own label is at most as large
        short = hooked.alias("a").join(hooked.select(F.col("node").alias("_n"), F.col("component").alias("_up")), F.col("a.component") == F.col("_n")).select("a.node", F.least("a.component", "_up").alias("component"))
        new = written(short)
        if new.exceptAll(label).isEmpty():
            return new
        label = new


def stars(cliques: DataFrame, by: list[str]) -> DataFrame:
    """(src, dst, weight): each clique's (or each part's, by more columns) least node linked to its nodes, itself too; cliques: clique, node, weight."""
    lead = cliques.groupBy(*by).agg(F.min("node").alias("_lead"))
    return cliques.join(lead, by).select(F.col("_lead").alias("src"), F.col("node").alias("dst"), "weight")


def ordered_nodes(edges: DataFrame, order: str) -> DataFrame:
    """(node, rank): distinct nodes of edges by first appearance; order: a column that numbers the edges."""
    rows = edges.select(F.explode(F.array(F.struct((2 * F.col(order)).alias("at"), F.col("src").alias("node")), F.struct((2 * F.col(order) + 1).alias("at"), F.col("dst").alias("node")))).alias("x"))
    return ranked(rows.groupBy("x.node").agg(F.min("x.at").alias("_at")), [("_at", True)], "rank").select("node", "rank")
