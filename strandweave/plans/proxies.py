"""Stand-ins for sequencing data from the driver's tables, as DataFrames and as SQL.

alignments: lineitem (names are order keys, references suppliers, positions prices); sequences: suppliers; DNA: the letters
of documents' texts put on four bases.  The SQL is a chain of common table expressions with the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MapConfig
from ..operators.contacts import sequence_table

CONFIG = MapConfig(min_insert=100, min_mapq=10, strong=30, bin_size=20_000, min_len=1000, min_signal=2)
TIPS = MapConfig(min_insert=100, min_mapq=10, strong=30, bin_size=20_000, tip_size=40_000, min_len=1000, min_signal=2)
PAIR_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("s_suppkey") % 10 == 0, 500).otherwise(110_000 + F.col("s_suppkey") * 7919 % 50_000)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("ref_id"), F.col("s_name").alias("name"), length.cast("long").alias("length"))


def counted_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site counts by name; one sequence in seventeen is missing."""
    key = F.col("ref_id").cast("long")
    rows = references(spark, sf_dir).where(key % 17 != 0)
    tips = F.array((key * 3 % 5).cast("int"), (key * 5 % 7).cast("int"))
    return rows.select("name", "length", (key * 31 % 23).cast("int").alias("sites"), tips.alias("tip_sites"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_table(references(spark, sf_dir), counted_fasta(spark, sf_dir), CONFIG.min_len)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda c, b: F.when(c, b).otherwise(0)
    flag = bit(F.col("l_returnflag") == "N", 0x2) + bit(F.col("l_linestatus") == "F", 0x10) + F.when(F.col("l_linenumber") % 2 == 0, 0x80).otherwise(0x40) + bit(F.col("l_discount") >= 0.095, 0x400)
    op = lambda o, n: F.struct(F.lit(o).alias("op"), F.lit(n).alias("len"))
    cigar = F.when(F.col("l_tax") > 0.055, F.array(op(4, 75), op(0, 25))).when(F.col("l_tax") > 0.045, F.array(op(4, 10), op(0, 90))).otherwise(F.array(op(0, 100)))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_name"), *PAIR_ORDER, flag.alias("flag"), F.col("l_suppkey").cast("int").alias("ref_id"), F.floor("l_extendedprice").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), cigar.alias("cigar"), F.lit(100).cast("long").alias("alen"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, description, seq): documents' letters as bases."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(key.alias("id"), F.concat(key, F.lit(" flag=1 multi="), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(".2500 len=1")).alias("description"), F.translate(letters, LETTERS, BASES).alias("seq"))


SEQUENCES = """
refs AS (SELECT CAST(s_suppkey AS INT) AS ref_id, s_name AS name, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 500 ELSE 110000 + s_suppkey * 7919 % 50000 END AS BIGINT) AS length FROM supplier),
seqs AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS BIGINT) AS seq_id, ref_id, name, length, CAST(coalesce(sum(length) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(ref_id * 31 % 23 AS BIGINT) AS sites, CAST(ref_id * 3 % 5 AS BIGINT) AS left_sites, CAST(ref_id * 5 % 7 AS BIGINT) AS right_sites
  FROM refs WHERE ref_id % 17 <> 0 AND length >= 1000)"""
READS = """
aln AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 128 ELSE 64 END + CASE WHEN l_discount >= 0.095 THEN 1024 ELSE 0 END AS flag,
  CAST(l_suppkey AS INT) AS ref_id, CAST(floor(l_extendedprice) AS BIGINT) AS pos, CAST(floor(l_quantity) AS INT) AS mapq FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn,
  CASE WHEN l_tax > 0.055 THEN FALSE WHEN l_tax > 0.045 THEN flag & 16 > 0 ELSE TRUE END AS strong,
  pos + CASE WHEN flag & 16 > 0 THEN 100 ELSE 0 END AS five FROM aln WHERE flag & 3332 = 0),
p AS (SELECT x.l_orderkey AS q, CASE WHEN x.flag & 128 > 0 THEN y ELSE x END AS r1, CASE WHEN x.flag & 128 > 0 THEN x ELSE y END AS r2 FROM r AS x JOIN r AS y ON x.l_orderkey = y.l_orderkey AND y.rn = x.rn + 1 WHERE x.rn % 2 = 1),
m AS (SELECT q, r1, r2, s1.seq_id AS a, s2.seq_id AS b, s1.length AS la, s2.length AS lb FROM p LEFT JOIN seqs AS s1 ON p.r1.ref_id = s1.ref_id LEFT JOIN seqs AS s2 ON p.r2.ref_id = s2.ref_id),
o AS (SELECT *, CASE WHEN b < a THEN b ELSE a END AS i, CASE WHEN b < a THEN a ELSE b END AS j, CASE WHEN b < a THEN r2.five ELSE r1.five END AS pos_i, CASE WHEN b < a THEN r1.five ELSE r2.five END AS pos_j, CASE WHEN b < a THEN lb ELSE la END AS length_i, CASE WHEN b < a THEN la ELSE lb END AS length_j FROM m),
t AS (SELECT *, CASE WHEN length_i > 2 * {tip} THEN CASE WHEN pos_i < {tip} THEN 0 WHEN pos_i > length_i - {tip} THEN 1 END WHEN pos_i < length_i - pos_i THEN 0 WHEN pos_i > length_i - pos_i THEN 1 END AS k,
  CASE WHEN length_j > 2 * {tip} THEN CASE WHEN pos_j < {tip} THEN 0 WHEN pos_j > length_j - {tip} THEN 1 END WHEN pos_j < length_j - pos_j THEN 0 WHEN pos_j > length_j - pos_j THEN 1 END AS l FROM o),
cls AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'ref_excluded' WHEN NOT (r1.mapq >= 10 AND r2.mapq >= 10 AND r1.strong AND r2.strong) THEN 'poor_match'
  WHEN r1.flag & 2 > 0 AND r2.pos - r1.pos < 100 THEN 'short_insert' WHEN {tipped} AND (k IS NULL OR l IS NULL) THEN 'not_tip' ELSE 'accepted' END AS status FROM t),
contacts AS (SELECT i, j, count(*) AS n FROM cls WHERE status = 'accepted' GROUP BY i, j)"""
BINS = """
grp AS (SELECT *, CAST(greatest(1, floor(CAST(length AS DOUBLE) / 20000 + 0.5)) AS BIGINT) AS n_bins FROM seqs),
grouped AS (SELECT *, CAST(coalesce(sum(n_bins) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_bin, list_transform(range(0, n_bins + 1), lambda i: CASE WHEN i = n_bins THEN length ELSE CAST(floor(i * (CAST(length AS DOUBLE) / n_bins)) AS BIGINT) END) AS edges FROM grp),
bins AS (SELECT seq_id, length, first_bin, edges, u.k AS bin_no, first_bin + u.k AS bin_id FROM grouped, unnest(range(0, n_bins)) AS u(k))"""
EXTENTS = """
ext AS (SELECT least(bi, bj) AS bi, greatest(bi, bj) AS bj, count(*) AS n FROM (
  SELECT gi.first_bin + least(len(list_filter(gi.edges[2:], lambda e: e < pos_i)), gi.n_bins - 1) AS bi, gj.first_bin + least(len(list_filter(gj.edges[2:], lambda e: e < pos_j)), gj.n_bins - 1) AS bj
  FROM cls JOIN grouped AS gi ON cls.i = gi.seq_id JOIN grouped AS gj ON cls.j = gj.seq_id WHERE status IN ('accepted', 'not_tip')) GROUP BY 1, 2)"""
DNA = """
dna AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""


def sql(*parts: str, select: str, tip: int | None = None) -> str:
    """A query over the named parts, in their order."""
    whole = ",".join(p.strip("\n") for p in parts)
    head = whole.replace("{tip}", str(tip or 40_000)).replace("{tipped}", "TRUE" if tip else "FALSE")
    return f"WITH {head} {select}" if head else select
