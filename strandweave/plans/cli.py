"""spark-submit entry: communities of a weighted graph file."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import ranked
from ..operators.community import louvain
from ..operators.graph import graph_info, soft_membership, with_isolates
from ..sources.clusters import read_edges, read_graphml
from ..sources.sinks import write_communities, write_graphml
from ..tables import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Louvain communities of a weighted graph")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--no-isolates", action="store_true", help="leave nodes without a neighbour out")
    group.add_argument("--ragbag", action="store_true", help="put nodes without a neighbour into one community")
    p.add_argument("--otype", choices=["hard", "simple", "maxaff"], default="hard", help="membership of nodes with edges to other communities")
    p.add_argument("--ifmt", choices=["edgelist", "graphml"], default="edgelist")
    p.add_argument("--ofmt", choices=["mcl", "graphml"], default="mcl")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("input")
    p.add_argument("output")
    return p


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges between whole numbers, (node, name) or None): ids that aren't whole numbers are numbered in their order."""
    edges = written(edges.withColumns({x: F.col(x).cast("string") for x in ("src", "dst")}))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    if ids.where("try_cast(name as long) is null or cast(try_cast(name as long) as string) <> name").isEmpty():
        return edges.withColumns({x: F.col(x).cast("long") for x in ("src", "dst")}), None
    names = written(ranked(ids, [("name", True)], "node"))
    for x in ("src", "dst"):
        edges = edges.join(names.select(F.col("name").alias(x), F.col("node").alias(f"_{x}")), x)
    return edges.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"), "weight"), names


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    edges = (read_edges if a.ifmt == "edgelist" else read_graphml)(spark, a.input)
    edges, names = numbered(edges)
    print(graph_info(edges).first())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("u")).distinct()
    found = with_isolates(louvain(edges, seed=a.seed), nodes, edges, "drop" if a.no_isolates else "ragbag" if a.ragbag else "keep")
    members = soft_membership(edges, found, a.otype)
    if names is not None:
        members = members.join(names, "node").select(F.col("name").alias("node"), "cl_id", "membership")
    (write_communities if a.ofmt == "mcl" else write_graphml)(members, a.output)


if __name__ == "__main__":
    main()
