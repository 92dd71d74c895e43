"""FASTA: whole records by Spark's text reader, which splits large files at record starts and decodes .gz and .bz2 by suffix."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import count_sites, tip_sites


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, description, seq): id is the header up to white space, description the whole header.  What precedes the first header of a file is left out."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    # only a file's first record still has its mark; a line that starts a record there without one is no record
    text = F.regexp_replace("value", r"^>", "")
    head, body = F.substring_index(text, "\n", 1), F.regexp_replace(text, r"^[^\n]*\n?", "")
    head = F.trim(F.regexp_replace(head, "\r", ""))
    out = rows.where(F.trim(F.regexp_replace("value", r"[>\s]", "")) != "")
    return out.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def count_records(spark: SparkSession, path: str | list[str]) -> int:
    """Header lines."""
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def counted_sequences(fasta: DataFrame, enzymes: list[str], min_len: int = 0, tip: int | None = None, linear: bool = True) -> DataFrame:
    """(name, length, sites, and tip_sites with tip): sequences of min_len at least, their bases gone."""
    rows = fasta.where(F.length("seq") >= min_len)
    more = [tip_sites("seq", enzymes, tip).alias("tip_sites")] if tip else []
    return rows.select(F.col("id").alias("name"), F.length("seq").cast("long").alias("length"), count_sites("seq", enzymes, linear).alias("sites"), *more)


def lookup(fasta: DataFrame, names: DataFrame) -> DataFrame:
    """Records of some names (name): a join in place of an index."""
    return fasta.join(names.select(F.col("name").alias("id")), "id", "left_semi")


class IndexedSequences:
    """Keyed access to the records of a FASTA table: each look-up is a filter that Spark pushes down, so nothing is built or held."""

    def __init__(self, fasta: DataFrame) -> None:
        self.fasta = fasta

    def __getitem__(self, name: str) -> Row:
        """(id, description, seq) of the record; a KeyError where there is none."""
        found = self.fasta.where(F.col("id") == name).first()
        if found is None:
            raise KeyError(name)
        return found

    def __len__(self) -> int:
        return self.fasta.count()

    def __iter__(self) -> Iterator[str]:
        """Names, partition by partition."""
        return (r.id for r in self.fasta.select("id").toLocalIterator())
