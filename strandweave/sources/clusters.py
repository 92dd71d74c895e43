"""Cluster solutions, tours, graphs and reports.  Lines are numbered by the parts of a file that tasks read, so a file may have any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.prefix import ranked, running_sum


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a file from 0, as they are; nothing is sorted: a line's number is its place in its part, after the parts before it."""
    at = F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_path"), at.alias("_start"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    parts = rows.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))  # a row for each part
    return rows.join(F.broadcast(base), ["_path", "_start"]).select((F.col("_base") + F.col("_at")).cast("int").alias("n"), "line")


def numbered_lines(spark: SparkSession, path: str, stop_at_blank: bool = True) -> DataFrame:
    """(n, line) of a file from 0, trimmed, up to the first blank line."""
    rows = _lines(spark, path).select("n", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    if not stop_at_blank:
        return rows
    end = rows.where("line = ''").agg(F.coalesce(F.min("n"), F.lit(2**31 - 1)).alias("_end"))  # one row
    return rows.crossJoin(F.broadcast(end)).where(F.col("n") < F.col("_end")).drop("_end")


def read_mcl(spark: SparkSession, path: str) -> DataFrame:
    """(cl_id, seq_id): line n holds the ids of cluster n."""
    return numbered_lines(spark, path).select(F.col("n").alias("cl_id"), F.explode(F.transform(F.split("line", r"\s+"), lambda x: x.cast("int"))).alias("seq_id"))


def read_table(spark: SparkSession, path: str, seq_col: int | None = 0, cl_col: int = 1) -> DataFrame:
    """(cl_id, seq_id) of two columns; with seq_col None, of one column of clusters, sequences being numbered by line."""
    if seq_col == cl_col:
        raise ValueError("sequence and cluster columns must differ")
    rows = numbered_lines(spark, path)
    if seq_col is None:
        return rows.select(F.col("line").cast("int").alias("cl_id"), F.col("n").alias("seq_id"))
    f = F.split("line", r"\s+")
    checked = F.when(F.size(f) >= 2, f).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), "line")).cast("array<string>"))
    return rows.select(checked.alias("_f")).select(F.col("_f")[cl_col].cast("int").alias("cl_id"), F.col("_f")[seq_col].cast("int").alias("seq_id"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(cl_id, seq_id) of a tree file: the path without its last part names a module; modules are numbered by descending size, then by name."""
    rows = numbered_lines(spark, path).where(~F.col("line").startswith("#"))
    f = F.split("line", r"\s+")
    module = F.regexp_replace(f[0], r":?[^:]*$", "")
    rows = rows.select(module.alias("_module"), F.element_at(f, -1).cast("int").alias("seq_id"))
    sizes = rows.groupBy("_module").count()
    ids = ranked(sizes, [("count", False), ("_module", True)], "cl_id").select("_module", F.col("cl_id").cast("int").alias("cl_id"))
    return rows.join(ids, "_module").select("cl_id", "seq_id")


def read_tour(spark: SparkSession, path: str) -> tuple[dict[str, object], DataFrame]:
    """(header, (rank, node)): nodes from 0, the end mark gone."""
    rows = numbered_lines(spark, path)
    rows = rows.where("line <> 'EOF'")
    at = rows.where(F.col("line").startswith("TOUR_SECTION")).agg(F.min("n")).first()[0]
    if at is None:
        raise ParseError("there is no TOUR_SECTION")
    # "KEY : VALUE", cut at the first colon
    head = rows.where((F.col("n") < at) & F.col("line").contains(":")).select(F.split("line", ":", 2).alias("f")).select(F.trim(F.col("f")[0]).alias("k"), F.trim(F.col("f")[1]).alias("v")).collect()
    header = {r.k: int(r.v) if r.k == "DIMENSION" else r.v for r in head}
    body = rows.where((F.col("n") > at) & (F.expr("try_cast(line as int)") > 0))
    return header, body.select((F.col("n") - at - 1).cast("int").alias("rank"), (F.expr("try_cast(line as int)") - 1).alias("node"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of an edge list; a third field may be the weight or a dictionary that holds it; 1 without."""
    f = F.split(F.trim("value"), r"\s+", 3)
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(f.alias("_f"))
    weight = F.coalesce(F.expr("try_cast(get(_f, 2) as double)"), F.expr(r"try_cast(regexp_extract(get(_f, 2), '[\'\"]weight[\'\"]\\s*:\\s*([0-9.eE+-]+)', 1) as double)"), F.lit(1.0))
    return rows.select(F.col("_f")[0].cast("long").alias("src"), F.col("_f")[1].cast("long").alias("dst"), weight.alias("weight"))


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of a GraphML file with weighted edges; node ids are strings."""
    keys = spark.read.format("xml").option("rowTag", "key").load(path)
    name = "weight"
    weight_key = [r[0] for r in keys.where(F.col("`_attr.name`") == name).select("_id").collect()] if "_attr.name" in keys.columns else []
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_key string, _VALUE string>>").load(path)
    own = F.filter("data", lambda d: d["_key"].isin(*(weight_key or [name])))
    return edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(F.get(own, F.lit(0))["_VALUE"].cast("double"), F.lit(1.0)).alias("weight"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, coverage, sites, length) of a coverage report in JSON: seq_info maps names to those; sites may be a number or [left, right]."""
    kind = "seq_info map<string, struct<coverage: double, sites: string, length: bigint>>"
    rows = spark.read.option("multiLine", True).schema(kind).json(path).select(F.explode("seq_info").alias("name", "v"))
    sites = F.col("v.sites")
    pair = F.from_json(sites, "array<int>")
    return rows.select("name", F.col("v.coverage").alias("coverage"), F.when(sites.startswith("["), pair).otherwise(F.array(sites.cast("int"))).alias("sites"), F.col("v.length").alias("length"))


def parse_yaml_report(spark: SparkSession, path: str) -> DataFrame:
    """The same of a report in block-style YAML of that shape."""
    rows = _lines(spark, path).where(F.trim("line") != "")
    depth = F.length(F.regexp_extract("line", r"^( *)", 1))
    rows = rows.select("n", depth.alias("depth"), F.regexp_extract("line", r"^ *['\"]?(.*?)['\"]?:(?:\s|$)", 1).alias("key"), F.trim(F.regexp_extract("line", r":\s+(.*)$", 1)).alias("value"), F.trim("line").alias("item"))
    levels = [r[0] for r in rows.where("item not like '-%'").select("depth").distinct().orderBy("depth").limit(3).collect()]  # the three outer levels
    if len(levels) < 3:
        raise ParseError("the report isn't a map of sequences")
    # lines of a name: as many names begin up to each
    begins = (F.col("depth") == levels[1]) & ~F.col("item").startswith("- ")
    rows = running_sum(rows, "n", begins.cast("long"), "_before").withColumn("_name", F.col("_before") + begins.cast("long"))
    w = Window.partitionBy("_name").orderBy("n")
    name = F.when(F.col("_name") > 0, F.first("key").over(w))
    field = F.last(F.when(F.col("depth") >= levels[2], F.when(F.col("item").startswith("- "), None).otherwise(F.col("key"))), True).over(w)
    value = F.when(F.col("item").startswith("- "), F.trim(F.expr("substring(item, 3)"))).otherwise(F.when(F.col("value") != "", F.col("value")))
    rows = rows.select("n", name.alias("name"), field.alias("field"), value.alias("value"), (F.col("depth") >= levels[2]).alias("_in") | F.col("item").startswith("- "))
    rows = rows.toDF("n", "name", "field", "value", "inner").where("inner and value is not null")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    every = F.array_sort(F.collect_list(F.when(F.col("field") == "sites", F.struct("n", "value"))))
    out = rows.groupBy("name").agg(pick("coverage").cast("double").alias("coverage"), every.alias("_s"), pick("length").cast("long").alias("length"))
    sites = F.flatten(F.transform("_s", lambda s: F.transform(F.split(F.regexp_replace(s["value"], r"[\[\]\s]", ""), ","), lambda x: x.cast("int"))))
    return out.select("name", "coverage", sites.alias("sites"), "length")
