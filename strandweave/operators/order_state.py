"""Order, orientation and mask of sequences as an immutable table: (seq_id, pos, ori, mask, length).

Each change gives a new table, a row for each sequence, which is written: what follows reads it, not the map that it came from.  Accepted sequences (mask true) take the first positions, the others follow in the order that they had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import dense_ids, ranked, running_sum
from ..tables import written


def initial(sequences: DataFrame) -> DataFrame:
    """In the order of ids, all forward and accepted."""
    return sequences.select("seq_id", F.col("seq_id").cast("int").alias("pos"), F.lit(1).cast("byte").alias("ori"), F.lit(True).alias("mask"), "length")


def repositioned(state: DataFrame) -> DataFrame:
    """Positions anew: accepted first, then by position."""
    state = written(state)
    rows = dense_ids(state.withColumnRenamed("pos", "_pos"), "_pos", "pos", [(~F.col("mask")).cast("int")])
    return written(rows.select("seq_id", "pos", "ori", "mask", "length"))


def with_mask(state: DataFrame, mask: DataFrame) -> DataFrame:
    """mask: seq_id, accepted, for each sequence."""
    rows = state.join(mask.select("seq_id", F.col("accepted").alias("_m")), "seq_id", "left")
    checked = F.when(F.col("_m").isNotNull(), F.col("_m")).otherwise(F.raise_error(F.lit("the mask lacks a sequence")).cast("boolean"))
    return repositioned(rows.withColumn("mask", checked).drop("_m"))


def with_order(state: DataFrame, order: DataFrame, implicit_excluded: bool = False) -> DataFrame:
    """order: seq_id, rank, and ori (forward if there is none); of all sequences, or of exactly the accepted ones with implicit_excluded."""
    if "ori" not in order.columns:
        order = order.withColumn("ori", F.lit(1))
    given = order.select("seq_id", F.col("rank").alias("_rank"), F.col("ori").cast("byte").alias("_ori"))
    asked = state.where("mask") if implicit_excluded else state
    met = asked.select("seq_id", F.lit(1).alias("_a")).join(given.groupBy("seq_id").agg(F.count("*").alias("_n")), "seq_id", "full")
    other, twice = met.agg(F.count_if(F.col("_a").isNull() | F.col("_n").isNull()), F.count_if(F.col("_n") > 1)).first()
    if other:
        raise ValueError("the order must hold exactly the " + ("accepted" if implicit_excluded else "known") + " sequences")
    if twice:
        raise ValueError("the order holds a sequence twice")
    rows = state.join(given, "seq_id", "left")
    count = F.lit(1 << 40)
    # what isn't in the order comes after all that is
    key = F.coalesce(F.col("_rank").cast("long"), count + F.col("pos"))
    rows = rows.withColumns({"pos": key, "ori": F.coalesce("_ori", "ori")}).select("seq_id", "pos", "ori", "mask", "length")
    return repositioned(rows)


def flipped(state: DataFrame, seq_id: int) -> DataFrame:
    return state.withColumn("ori", F.when(F.col("seq_id") == seq_id, -F.col("ori")).otherwise(F.col("ori")).cast("byte"))


def masked(state: DataFrame, seq_id: int) -> DataFrame:
    return repositioned(state.withColumn("mask", F.col("mask") & (F.col("seq_id") != seq_id)))


def shuffled(state: DataFrame, seed: int) -> DataFrame:
    """A random order that the seed fixes, by digests of ids; accepted sequences stay first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq_id").cast("string")).cast("binary"))
    rows = ranked(state.drop("pos"), [("mask", False), (digest, True)], "pos")
    return rows.select("seq_id", F.col("pos").cast("int").alias("pos"), "ori", "mask", "length")


def accepted_order(state: DataFrame) -> DataFrame:
    """(seq_id, rank, ori) of the accepted sequences."""
    return state.where("mask").select("seq_id", F.col("pos").alias("rank"), "ori")


def gapless_positions(state: DataFrame) -> DataFrame:
    """(dense_id, pos, ori): positions of the accepted sequences under ids without gaps."""
    return dense_ids(state.where("mask"), "seq_id", "dense_id").select("dense_id", "pos", "ori")


def all_positions(state: DataFrame) -> DataFrame:
    return state.select("pos", "seq_id", "ori")


def counts(state: DataFrame) -> DataFrame:
    """(accepted, excluded)."""
    return state.agg(F.count_if("mask").alias("accepted"), F.count_if(~F.col("mask")).alias("excluded"))


def lengths(state: DataFrame, exclude_masked: bool = False) -> DataFrame:
    return (state.where("mask") if exclude_masked else state).select("seq_id", "length")


def is_before(state: DataFrame, a: int, b: int) -> bool:
    """Whether a stands before b."""
    if a == b:
        raise ValueError("two sequences are compared")
    at = {r.seq_id: r.pos for r in state.where(F.col("seq_id").isin(a, b)).select("seq_id", "pos").collect()}
    return at[a] < at[b]


def intervening(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the total length strictly between their positions, from one prefix sum."""
    rows = running_sum(state.select("seq_id", "pos", "length"), "pos", "length", "_p")
    names = pairs.columns
    for x in ("a", "b"):
        own = rows.select(F.col("seq_id").alias(x), F.struct("pos", F.col("_p").alias("p"), F.col("length").alias("n")).alias(f"_{x}"))
        pairs = pairs.join(own, x)
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    gap = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(high["p"] - low["p"] - low["n"])
    return pairs.select(*names, gap.alias("between_length"))
