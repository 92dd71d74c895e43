"""Corpus pipeline: five stages, each written as Parquet and read again as the documents of the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return the columns
of documents; where a stage changes a text, n_chars follows it.

Edge cases: null and empty texts are scored like any text, and of those that pass one stays; documents without an id can't be told
apart and are kept by the near-duplicate stage, while of rows that repeat an id one stays; a document of whose text a stage leaves
nothing but white space goes; ties don't occur, as ids decide; empty tables give empty results; columns beside those of documents are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import decontam, packing, quality, simhash, suffixdedup
from strandweave.tables import shared_folder, written


def fresh(docs: DataFrame, name: str) -> str:
    """The name, or one like it that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at its threshold at least; it is fitted on labels outside the held-out fold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "quality_score")
    return quality.scored(docs, model, into=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 at least), the document with the smallest id."""
    stays = fresh(docs, "stays")
    ids = written(simhash.representatives(docs).select(F.col("doc_id").alias(stays)))
    # texts are hashed to the ids that stay at every size, not sorted
    kept = docs.where("doc_id is not null").join(ids.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(stays), "left_semi")
    # rows that repeat an id are rare enough to look first
    if kept.count() > ids.count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier, too."""
    repeats = fresh(docs, "repeats")
    out = suffixdedup.without_repeats(docs, into=repeats)
    changed = F.col(f"{repeats}.n_removed") > 0
    out = out.where(~changed | (F.trim(f"{repeats}.text") != ""))
    out = out.withColumn("text", F.when(changed, F.col(f"{repeats}.text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items go; of the others, what occurs in an item is cut out."""
    hits = fresh(docs, "hits")
    out = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=hits, cut=True).where(F.size(f"{hits}.items") < 2)
    hit = F.col(f"{hits}.n_hit") > 0
    out = out.where(~hit | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, packed along the curve."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", first_of_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("packing", sequences),
]
#: SQL can't express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
