"""From alignments to contact tables: pairing, filtering, accounting, counting.

alignments: query_name, the columns of an order, flag, ref_id, pos, mapq, cigar (array of struct op, len), alen.
sequences: seq_id, ref_id, name, length, and sites where needed.  A contact table is (i, j, n) with i <= j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MapConfig
from ..functions.numeric import five_prime, has_flag, locate_bin, tip_of
from ..functions.prefix import dense_ids, running_sum
from ..tables import written

# Flag bits of an alignment.
PROPER, UNMAPPED, REVERSE, READ2, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x2, 0x4, 0x10, 0x80, 0x100, 0x400, 0x800
#: Statuses in the order in which they are tried.
STATUSES = ("ref_excluded", "poor_match", "short_insert", "not_tip", "accepted")


def sequence_table(references: DataFrame, fasta: DataFrame, min_len: int = 0) -> DataFrame:
    """references (ref_id, name, length) joined with counted sequences (name, length, sites...): those of min_len at least that both have.

    Ids follow the order of the references; offset is the sum of lengths before.  A length that differs is an error.
    The table is written, as everything else reads it, and more than once.
    """
    kept = references.where(F.col("length") >= min_len).alias("r").join(fasta.withColumnRenamed("length", "_length"), "name")
    same = F.when(F.col("_length") == F.col("length"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lengths differ: "), "name")).cast("long"))
    kept = kept.withColumn("length", same.cast("long")).drop("_length")
    return written(running_sum(dense_ids(written(kept), "ref_id", "seq_id"), "ref_id", "length", "offset"))


def missing_references(references: DataFrame, fasta: DataFrame, min_len: int = 0) -> int:
    """References of min_len at least that the sequences don't have."""
    return references.where(F.col("length") >= min_len).join(fasta, "name", "left_anti").count()


def reverse_index(sequences: DataFrame, field: str = "ref_id") -> DataFrame:
    """(field, seq_id); an error where a value isn't unique."""
    n = F.count("*").alias("n")
    checked = sequences.groupBy(field).agg(n, F.min("seq_id").alias("seq_id"))
    return checked.select(field, F.when(F.col("n") == 1, F.col("seq_id")).otherwise(F.raise_error(F.lit(f"{field} isn't unique")).cast("int")).alias("seq_id"))


def informative(alignments: DataFrame) -> DataFrame:
    """Mapped primary alignments that aren't duplicates."""
    return alignments.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED | SECONDARY | SUPPLEMENTARY | DUPLICATE)) == 0)


def paired(alignments: DataFrame, order: list[str], name: str = "query_name") -> DataFrame:
    """(query_name, a, b): the first with the second alignment of a name, the third with the fourth, and so on; one shuffle by name."""
    fields = [c for c in alignments.columns if c not in (name, *order)]
    w = Window.partitionBy(name).orderBy(*order)
    own = F.struct(*fields)
    rows = alignments.select(F.col(name).alias("query_name"), own.alias("a"), F.lead(own).over(w).alias("b"), F.row_number().over(w).alias("_rn"))
    return rows.where((F.col("_rn") % 2 == 1) & F.col("b").isNotNull()).drop("_rn")


def good_match(read: str, config: MapConfig) -> Column:
    """Mapping quality, and with config.strong a match of that length at the 5' end."""
    good = F.col(f"{read}.mapq") >= config.min_mapq
    if config.strong is not None:
        cigar = F.col(f"{read}.cigar")
        end = F.when(has_flag(f"{read}.flag", REVERSE), F.try_element_at(cigar, F.lit(-1))).otherwise(F.try_element_at(cigar, F.lit(1)))
        good &= F.coalesce((end["op"] == 0) & (end["len"] >= config.strong), F.lit(False))
    return good


def classified(pairs: DataFrame, sequences: DataFrame, config: MapConfig) -> DataFrame:
    """Pairs with their status and, of both ends in the order of sequence ids, seq ids i, j, 5' positions, lengths and tips k, l."""
    swap = has_flag("a.flag", READ2)
    rows = pairs.select("query_name", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("r1"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("r2"))
    lookup = sequences.select("ref_id", "seq_id", "length")
    for r in ("1", "2"):
        one = lookup.select(F.col("ref_id").alias(f"_ref{r}"), F.col("seq_id").alias(f"_s{r}"), F.col("length").alias(f"_l{r}"))
        rows = rows.join(one, F.col(f"r{r}.ref_id") == F.col(f"_ref{r}"), "left")
    place = lambda r: five_prime(f"r{r}.pos", f"r{r}.alen", has_flag(f"r{r}.flag", REVERSE))
    one, two = (F.struct(F.col(f"_s{r}").alias("s"), place(r).cast("long").alias("p"), F.col(f"_l{r}").alias("n")) for r in ("1", "2"))
    rows = rows.withColumns({"_one": one, "_two": two})
    back = F.coalesce(F.col("_s2") < F.col("_s1"), F.lit(False))
    rows = rows.withColumns({"_x": F.when(back, F.col("_two")).otherwise(F.col("_one")), "_y": F.when(back, F.col("_one")).otherwise(F.col("_two"))})
    excluded = F.col("_s1").isNull() | F.col("_s2").isNull()
    poor = ~(good_match("r1", config) & good_match("r2", config))
    short = F.lit(False)
    if config.min_insert:
        # the signed difference decides, so a proper pair whose second read lies upstream always goes
        short = has_flag("r1.flag", PROPER) & (F.col("r2.pos") - F.col("r1.pos") < config.min_insert)
    k = l = F.lit(None).cast("byte")
    not_tip = F.lit(False)
    if config.tip_based:
        k, l = tip_of("_x.p", "_x.n", config.tip_size), tip_of("_y.p", "_y.n", config.tip_size)
        not_tip = k.isNull() | l.isNull()
    status = F.when(excluded, STATUSES[0]).when(poor, STATUSES[1]).when(short, STATUSES[2]).when(not_tip, STATUSES[3]).otherwise(STATUSES[4])
    return rows.select("query_name", status.alias("status"), F.col("_x.s").alias("i"), F.col("_y.s").alias("j"), F.col("_x.p").alias("pos_i"), F.col("_y.p").alias("pos_j"), F.col("_x.n").alias("length_i"), F.col("_y.n").alias("length_j"), k.alias("k"), l.alias("l"))


def status_counts(pairs: DataFrame) -> DataFrame:
    """(status, n) of classified pairs."""
    return pairs.groupBy("status").agg(F.count("*").alias("n"))


def counted(pairs: DataFrame) -> DataFrame:
    """Whole-sequence contacts of accepted pairs."""
    return pairs.where("status = 'accepted'").groupBy("i", "j").agg(F.count("*").alias("n"))


def counted_tips(pairs: DataFrame) -> DataFrame:
    """Contacts by tips (i, j, k, l, n) of accepted pairs."""
    return pairs.where("status = 'accepted'").groupBy("i", "j", "k", "l").agg(F.count("*").alias("n"))


def counted_extents(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """Contacts by bins (bi, bj, n), bi <= bj, of pairs accepted or only off the tips; bins: seq_id, first_bin, edges."""
    rows = pairs.where(F.col("status").isin("accepted", "not_tip"))
    for x in ("i", "j"):
        own = bins.select(F.col("seq_id").alias(x), F.col("first_bin").alias(f"_f{x}"), F.col("edges").alias(f"_e{x}"))
        rows = rows.join(own, x).withColumn(f"_b{x}", F.col(f"_f{x}") + locate_bin(f"_e{x}", f"pos_{x}")).drop(f"_f{x}", f"_e{x}")
    return rows.groupBy(F.least("_bi", "_bj").alias("bi"), F.greatest("_bi", "_bj").alias("bj")).agg(F.count("*").alias("n"))


def symmetric(contacts: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Both triangles of an upper-triangle table; the diagonal stays as it is."""
    names = contacts.columns
    other = contacts.where(F.col(i) != F.col(j)).select(*[F.col({i: j, j: i}.get(c, c)).alias(c) for c in names])
    return contacts.unionByName(other)


def symmetric_tips(tips: DataFrame) -> DataFrame:
    """Both triangles of a tip table: (i, j, k, l) is also (j, i, l, k) off the diagonal blocks, which stay as they are."""
    other = tips.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("l").alias("k"), F.col("k").alias("l"), "n")
    return tips.select("i", "j", "k", "l", "n").union(other).groupBy("i", "j", "k", "l").agg(F.sum("n").alias("n"))


def flipped(tips: DataFrame) -> DataFrame:
    return tips.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("l").alias("k"), F.col("k").alias("l"), "n")


def map_weight(contacts: DataFrame, value: str = "n") -> DataFrame:
    """(weight): the sum over the symmetric map of an upper-triangle table."""
    return contacts.agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col(value)).otherwise(2 * F.col(value))), F.lit(0)).alias("weight"))


def is_empty(contacts: DataFrame) -> bool:
    return contacts.where("n <> 0").isEmpty()


def added(a: DataFrame, b: DataFrame, value: str = "n") -> DataFrame:
    """Sum of two tables with equal keys."""
    keys = [c for c in a.columns if c != value]
    return a.unionByName(b).groupBy(*keys).agg(F.sum(value).alias(value))


def same_sequences(a: DataFrame, b: DataFrame) -> bool:
    """Whether ids, names, lengths (and sites, where both have them) agree."""
    keys = ["seq_id", "name", "length", *(["sites"] if "sites" in a.columns and "sites" in b.columns else [])]
    a, b = a.select(keys), b.select(keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
