"""Outputs: reports, cluster files, sequences, graphs, and bundles of tables.

Spark writes folders of part files.  Where a single small file of a given name is wanted (a cluster's sequences), a task
writes it: set the folder to one that all executors share.
"""

from __future__ import annotations

import bz2
import gzip
import json
import os
from collections.abc import Iterable, Iterator
from typing import IO, Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..errors import NoReportError, UnknownOrientationError, UnsupportedError
from ..functions.sequence import reverse_complement
from ..operators.reports import mcl_lines, numbered_members


def save_bundle(tables: dict[str, DataFrame], config: dict[str, Any], folder: str, overwrite: bool = False) -> None:
    """Each table as Parquet and the configuration as JSON in a folder."""
    mode = "overwrite" if overwrite else "errorifexists"
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(config), json.dumps(sorted(tables)))], "config string, tables string").coalesce(1).write.mode(mode).json(f"{folder}/_bundle")


def load_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    head = spark.read.schema("config string, tables string").json(f"{folder}/_bundle").first()
    return {n: spark.read.parquet(f"{folder}/{n}") for n in json.loads(head.tables)}, json.loads(head.config)


def open_input(path: str) -> IO[str]:
    """A local text file; .gz and .bz2 by suffix."""
    if path.endswith(".bz2"):
        return bz2.open(path, "rt")
    return gzip.open(path, "rt") if path.endswith(".gz") else open(path)


def open_output(path: str, append: bool = False, compress: str | None = None, level: int = 6) -> IO[str]:
    """A local text file to write: compress is None, "gzip" or "bzip2"; append adds to what there is."""
    mode = "at" if append else "wt"
    if compress == "gzip":
        return gzip.open(path, mode, compresslevel=level)
    if compress == "bzip2":
        return bz2.open(path, mode)
    if compress:
        raise ValueError(f"{compress}: the codecs are gzip and bzip2")
    return open(path, mode)


def write_data(df: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists", compression: str | None = None) -> None:
    """Rows as JSON lines, CSV with a header, or plain text (one string column); mode "append" adds files."""
    out = df.write.mode(mode)
    if compression:
        out = out.option("compression", compression)
    if kind == "json":
        out.json(path)
    elif kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "plain":
        out.text(path)
    else:
        raise ValueError(f"{kind}: the kinds are json, csv and plain")


def write_copies(df: DataFrame, paths: Iterable[str], kind: str = "plain", **more: Any) -> None:
    """The same rows in several places, made once."""
    df = df.persist()
    try:
        for path in paths:
            write_data(df, path, kind, **more)
    finally:
        df.unpersist()


def dump_object(data: Any, kind: str = "json") -> str:
    """A small value as JSON, block-style YAML, or plain text."""
    if kind == "json":
        return json.dumps(data, indent=1)
    if kind == "yaml":
        return "\n".join(_yaml(data)) + "\n"
    if kind == "plain":
        return f"{data}\n"
    raise ValueError(f"{kind}: the kinds are json, yaml and plain")


def _yaml(data: Any) -> list[str]:
    """Lines of block-style YAML; scalars and empty collections are written as JSON, which YAML holds."""
    if isinstance(data, dict) and data:
        out = []
        for key, value in data.items():
            lines, head = _yaml(value), f"{json.dumps(key if isinstance(key, str) else str(key))}:"
            nested = isinstance(value, (dict, list)) and value
            out += [head, *(f"  {x}" for x in lines)] if nested else [f"{head} {lines[0]}"]
        return out
    if isinstance(data, list) and data:
        out = []
        for value in data:
            first, *rest = _yaml(value)
            out += [f"- {first}", *(f"  {x}" for x in rest)]
        return out
    return [json.dumps(data)]


def load_object(text: str, kind: str = "json") -> Any:
    """A small value from JSON, or from YAML where PyYAML is installed."""
    if kind == "json":
        return json.loads(text)
    if kind != "yaml":
        raise ValueError(f"{kind}: the kinds are json and yaml")
    try:
        import yaml
    except ImportError:
        raise UnsupportedError("reading YAML takes PyYAML") from None
    return yaml.safe_load(text)


def write_report(report: DataFrame | None, path: str, mode: str = "errorifexists") -> None:
    """A cluster report as CSV with a header, clusters in order; coverage columns only if there is any coverage."""
    if report is None:
        raise NoReportError("make the cluster report first")
    if report.where("cov_mean is not null").isEmpty():
        report = report.drop(*[c for c in report.columns if c.startswith("cov_")])
    report.orderBy("id").write.mode(mode).option("header", True).csv(path)


def write_mcl(members: DataFrame, sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of names for each cluster, in order, then a line for each sequence in none."""
    mcl_lines(members, sequences).orderBy(F.col("cl_id").asc_nulls_last(), "line").select("line").write.mode(mode).text(path)


def write_communities(partition: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of sorted node ids for each community."""
    lines = partition.groupBy("cl_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda x: x.cast("string")), " ").alias("line"))
    lines.orderBy("cl_id").select("line").write.mode(mode).text(path)


def write_edges(edges: DataFrame, path: str, sep: str = " ", mode: str = "errorifexists") -> None:
    edges.select("src", "dst", "weight").write.mode(mode).option("sep", sep).csv(path)


#: Members in a graph element at most.
GRAPH_ROWS = 10_000


def write_graphml(partition: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edges from communities to their nodes: GraphML documents with a directed graph for each community (several for one of many nodes)."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.count("*").over(Window.partitionBy("cl_id")) / GRAPH_ROWS))
    rows = partition.select(F.concat(F.lit("c"), "cl_id").alias("c"), F.col("node").cast("string").alias("node"), part.alias("part"))
    graphs = rows.groupBy("c", "part").agg(F.array_sort(F.collect_list("node")).alias("members"))
    ids = F.concat(F.array("c"), "members")
    node = F.transform(ids, lambda x: F.struct(x.alias("_id")))
    edge = F.transform("members", lambda x: F.struct(F.col("c").alias("_source"), x.alias("_target")))
    graphs = graphs.select(F.concat("c", F.lit("."), "part").alias("_id"), F.lit("directed").alias("_edgedefault"), node.alias("node"), edge.alias("edge"))
    graphs.write.mode(mode).format("xml").option("rootTag", 'graphml xmlns="http://graphml.graphdrawing.org/xmlns"').option("rowTag", "graph").save(path)


def write_tour_problem(distance: Any, base: str, fixed: list[tuple[int, int]] | None = None, runs: int = 5, seed: int = 1, trials: int | None = None) -> None:
    """Text files base.par and base.dat of a symmetric distance matrix, weights cut to whole numbers, for an outside tour solver."""
    n = len(distance)
    upper = "\n".join(" ".join(str(int(x)) for x in distance[i][i + 1 :]) for i in range(n - 1))
    with open(f"{base}.dat", "w") as out:
        out.write(f"NAME: {os.path.basename(base)}\nTYPE: TSP\nDIMENSION: {n}\nEDGE_WEIGHT_TYPE: EXPLICIT\nEDGE_WEIGHT_FORMAT: UPPER_ROW\n")
        if fixed:
            out.write("FIXED_EDGES_SECTION\n" + "".join(f"{a + 1} {b + 1}\n" for a, b in fixed) + "-1\n")
        out.write(f"EDGE_WEIGHT_SECTION\n{upper}\nEOF\n")
    with open(f"{base}.par", "w") as out:
        out.write(f"PROBLEM_FILE = {base}.dat\nTOUR_FILE = {base}.tour\nRUNS = {runs}\nSEED = {seed}\nMAX_TRIALS = {trials or 2 * n}\n")


def cluster_sequences(clusters: DataFrame, members: DataFrame, sequences: DataFrame, fasta: DataFrame, cluster_order: DataFrame | None = None, min_extent: int = 0) -> DataFrame:
    """(cl_id, name, n, id, description, seq): clusters' sequences by id, or in order and turned where their orientation is -1."""
    chosen = clusters.where(F.col("extent") >= min_extent).select("cl_id", F.col("name").alias("cluster"), "size")
    rows = numbered_members(members, cluster_order).join(chosen, "cl_id").join(sequences.select("seq_id", F.col("name").alias("contig"), "length"), "seq_id")
    rows = rows.join(fasta.select(F.col("id").alias("contig"), "seq"), "contig")
    known = F.when(F.col("ori").isNull(), "UNKNOWN").when(F.col("ori") == 1, "FORWARD").when(F.col("ori") == -1, "REVERSE").otherwise(F.raise_error(F.lit("an orientation is 1, -1 or unknown")).cast("string"))
    width = F.length(F.col("size").cast("string"))
    number = F.col("n").cast("string")
    id_ = F.concat("cluster", F.lit("_"), F.lpad(number, F.greatest(width, F.length(number)), F.lit("0")))
    seq = F.when(F.col("ori") == -1, reverse_complement("seq")).otherwise(F.col("seq"))
    return rows.select("cl_id", F.col("cluster").alias("name"), "n", id_.alias("id"), F.concat(F.lit("contig:"), "contig", F.lit(" ori:"), known, F.lit(" length:"), F.col("length").cast("string")).alias("description"), seq.alias("seq"))


def orientation_name(ori: int | None) -> str:
    """FORWARD, REVERSE or UNKNOWN."""
    try:
        return {1: "FORWARD", -1: "REVERSE", None: "UNKNOWN"}[ori]
    except KeyError:
        raise UnknownOrientationError(str(ori)) from None


def write_fasta(rows: DataFrame, folder: str, suffix: str = ".fna", clobber: bool = False, line: int = 60) -> list[str]:
    """One file <cluster's name><suffix> for each cluster of cluster_sequences(), written by its task a sequence at a time; returns the paths."""
    os.makedirs(folder, exist_ok=True)
    if not clobber and any(n.endswith(suffix) for n in os.listdir(folder)):
        raise FileExistsError(folder)
    ship(rows.sparkSession)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, made = None, None, []
        for part in parts:
            for r in part.itertuples():
                if r.name != name:
                    if out:
                        out.close()
                    name = r.name
                    path = f"{folder}/{name}{suffix}"
                    out = open(path, "w")
                    made.append(path)
                out.write(f">{r.id} {r.description}\n")
                out.writelines(f"{r.seq[i : i + line]}\n" for i in range(0, len(r.seq), line))
        if out:
            out.close()
        yield pd.DataFrame({"path": made})

    sorted_ = rows.repartition("name").sortWithinPartitions("name", "n")
    return sorted(r.path for r in sorted_.mapInPandas(write, "path string").collect())


def write_fasta_text(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """The same as a folder of part files for each cluster, by Spark's own writer."""
    text = F.concat(F.lit(">"), "id", F.lit(" "), "description", F.lit("\n"), "seq")
    rows.repartition("name").sortWithinPartitions("name", "n").select("name", text.alias("value")).write.mode(mode).partitionBy("name").text(folder)


def write_pieces(pieces: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pieces of split sequences as FASTA text."""
    pieces.select(F.concat(F.lit(">"), "piece_id", F.lit("\n"), "piece_seq")).write.mode(mode).text(path)


def shown(tensor: DataFrame, rows: int = 100) -> str:
    """A tip table's cells as text, in order."""
    cells = tensor.orderBy(*[c for c in tensor.columns if c in "ijkl"]).limit(rows).collect()
    return "\n".join(" ".join(str(x) for x in c) for c in cells)
