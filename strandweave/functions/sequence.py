"""Column functions over DNA strings: sites, composition, reverse complement, pieces, coverage in names."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownEnzymeError

# Recognition site and cut, counted from the site's first base on the top strand.
ENZYMES = {
    "AatII": ("GACGTC", 5), "AccI": ("GTMKAC", 2), "AciI": ("CCGC", 1), "AclI": ("AACGTT", 2), "AfeI": ("AGCGCT", 3), "AflII": ("CTTAAG", 1),
    "AgeI": ("ACCGGT", 1), "AluI": ("AGCT", 2), "ApaI": ("GGGCCC", 5), "ApaLI": ("GTGCAC", 1), "ApoI": ("RAATTY", 1), "AscI": ("GGCGCGCC", 2),
    "AseI": ("ATTAAT", 2), "AvaI": ("CYCGRG", 1), "AvaII": ("GGWCC", 1), "AvrII": ("CCTAGG", 1), "BamHI": ("GGATCC", 1), "BbsI": ("GAAGAC", 8),
    "BclI": ("TGATCA", 1), "BfaI": ("CTAG", 1), "BglII": ("AGATCT", 1), "BsaI": ("GGTCTC", 7), "BsiWI": ("CGTACG", 1), "BsmBI": ("CGTCTC", 7),
    "BspHI": ("TCATGA", 1), "BsrGI": ("TGTACA", 1), "BssHII": ("GCGCGC", 1), "BstBI": ("TTCGAA", 2), "BstUI": ("CGCG", 2), "ClaI": ("ATCGAT", 2),
    "Csp6I": ("GTAC", 1), "CviAII": ("CATG", 1), "DdeI": ("CTNAG", 1), "DpnI": ("GATC", 2), "DpnII": ("GATC", 0), "DraI": ("TTTAAA", 3),
    "EagI": ("CGGCCG", 1), "EcoRI": ("GAATTC", 1), "EcoRV": ("GATATC", 3), "FatI": ("CATG", 0), "FokI": ("GGATG", 14), "FspI": ("TGCGCA", 3),
    "HaeII": ("RGCGCY", 5), "HaeIII": ("GGCC", 2), "HgaI": ("GACGC", 10), "HhaI": ("GCGC", 3), "HincII": ("GTYRAC", 3), "HindIII": ("AAGCTT", 1),
    "HinfI": ("GANTC", 1), "HpaI": ("GTTAAC", 3), "HpaII": ("CCGG", 1), "HpyCH4IV": ("ACGT", 1), "KpnI": ("GGTACC", 5), "MboI": ("GATC", 0),
    "MfeI": ("CAATTG", 1), "MluCI": ("AATT", 0), "MluI": ("ACGCGT", 1), "MseI": ("TTAA", 1), "MspI": ("CCGG", 1), "NaeI": ("GCCGGC", 3),
    "NciI": ("CCSGG", 2), "NcoI": ("CCATGG", 1), "NdeI": ("CATATG", 2), "NheI": ("GCTAGC", 1), "NlaIII": ("CATG", 4), "NotI": ("GCGGCCGC", 2),
    "NruI": ("TCGCGA", 3), "NsiI": ("ATGCAT", 5), "PacI": ("TTAATTAA", 5), "PciI": ("ACATGT", 1), "PmeI": ("GTTTAAAC", 4), "PstI": ("CTGCAG", 5),
    "PvuI": ("CGATCG", 4), "PvuII": ("CAGCTG", 3), "RsaI": ("GTAC", 2), "SacI": ("GAGCTC", 5), "SacII": ("CCGCGG", 4), "SalI": ("GTCGAC", 1),
    "Sau3AI": ("GATC", 0), "Sau96I": ("GGNCC", 1), "ScaI": ("AGTACT", 3), "SfcI": ("CTRYAG", 1), "SmaI": ("CCCGGG", 3), "SnaBI": ("TACGTA", 3),
    "SpeI": ("ACTAGT", 1), "SphI": ("GCATGC", 5), "SspI": ("AATATT", 3), "StuI": ("AGGCCT", 3), "SwaI": ("ATTTAAAT", 4), "TaqI": ("TCGA", 1),
    "TfiI": ("GAWTC", 1), "XbaI": ("TCTAGA", 1), "XhoI": ("CTCGAG", 1), "XmaI": ("CCCGGG", 1),
}
# Ambiguity codes and their complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
CODES, COMPLEMENTS = "ACGTUMRWSYKVHDBXNacgtumrwsykvhdbxn", "TGCAAKYWSRMBDHVXNtgcaakywsrmbdhvxn"


def enzyme(name: str) -> tuple[str, int]:
    """Site and cut of an enzyme; an unknown name is an error that lists names like it."""
    if name not in ENZYMES:
        raise UnknownEnzymeError(name, difflib.get_close_matches(name, ENZYMES, n=10, cutoff=0.8))
    return ENZYMES[name]


def site_patterns(name: str) -> list[str]:
    """Lookahead patterns, a match at each site that is cut within a linear sequence, of both strands if they differ."""
    site, cut = enzyme(name)
    letters = lambda s: "".join(x if len(IUPAC[x]) == 1 else f"[{IUPAC[x]}]" for x in s)
    beyond = cut - len(site)
    out = [f"(?={letters(site)}" + (f".{{{beyond}}}" if beyond > 0 else "") + ")"]
    back = site.translate(str.maketrans(CODES, COMPLEMENTS))[::-1]
    if back != site:
        out.append((f"(?<=.{{{beyond}}})" if beyond > 0 else "") + f"(?={letters(back)})")
    return out


def count_sites(seq: Column | str, enzymes: list[str], linear: bool = True) -> Column:
    """Cut sites of all enzymes; a circular sequence is read on over its end."""
    seq = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    total = F.lit(0)
    for name in enzymes:
        reach = max(len(enzyme(name)[0]), enzyme(name)[1])
        text = seq if linear else F.concat(seq, F.substring(seq, 1, reach - 1))
        for pattern in site_patterns(name):
            total = total + F.regexp_count(text, F.lit(pattern))
    return total


def tip_sites(seq: Column | str, enzymes: list[str], tip: int) -> Column:
    """[left, right] sites of the ends: tip bases each, or halves of what is shorter than two tips, the odd base being the right's."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(seq)
    left = F.when(n < 2 * tip, F.floor(n / 2)).otherwise(F.lit(tip)).cast("int")
    right = F.when(n < 2 * tip, n - F.floor(n / 2)).otherwise(F.lit(tip)).cast("int")
    return F.array(count_sites(F.substring(seq, F.lit(1), left), enzymes), count_sites(F.substring(seq, n - right + 1, right), enzymes))


def gc_percent(seq: Column | str) -> Column:
    """100 times the share of G, C and S in either case; 0 of an empty sequence."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(seq, "[GCSgcs]", ""))) * 100.0 / n)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, CODES, COMPLEMENTS))


# Where assemblers write coverage.
#   SPAdes, in the name: NODE_<number>_length_<number>_cov_<decimal>
#   MEGAHIT, in the description: multi=<decimal>
SPADES_NAME, MEGAHIT_FIELD, DECIMAL = ("NODE_", "_length_", "_cov_"), "multi=", r"^\d+\.\d*"


def spades_coverage(name: Column | str) -> Column:
    """Coverage in a sequence's name; an error where there is none."""
    text = F.col(name) if isinstance(name, str) else name
    node, length, cov = SPADES_NAME
    number = F.substring_index(F.substring_index(text, cov, 1), length, -1)
    return _coverage(text, F.when(text.startswith(node) & number.rlike(r"^\d+$"), F.get(F.split(text, cov, 2), F.lit(1))))


def megahit_coverage(description: Column | str) -> Column:
    """Coverage in a sequence's description; an error where there is none."""
    text = F.col(description) if isinstance(description, str) else description
    return _coverage(text, F.get(F.split(text, MEGAHIT_FIELD, 2), F.lit(1)))


def _coverage(text: Column, rest: Column) -> Column:
    """The decimal that the rest begins with."""
    got = F.coalesce(F.regexp_extract(F.coalesce(rest, F.lit("")), DECIMAL, 0), F.lit(""))
    return F.when(got == "", F.raise_error(F.concat(F.lit("no coverage in "), F.coalesce(text, F.lit("null")))).cast("double")).otherwise(got.cast("double"))


def split_sequences(seqs: DataFrame, size: int, threshold: float = 1 / 3, legacy_floor_division: bool = False, id_: str = "id", seq: str = "seq") -> DataFrame:
    """(id, piece_no, piece_id, piece_seq, lo, hi): pieces of about size bases; a rest of threshold times the size is a piece of its own.

    legacy_floor_division: the quotient is floored before the threshold is added, which leaves it without effect.
    """
    n = F.length(seq)
    quotient = F.floor(n / size) if legacy_floor_division else n / F.lit(float(size))
    pieces = F.greatest(F.lit(1), F.floor(quotient + threshold)).cast("int")
    step = n.cast("double") / pieces
    rows = seqs.select(F.col(id_).alias("id"), F.col(seq).alias("_seq"), pieces.alias("_n"), step.alias("_step"), n.cast("long").alias("_len"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    lo = F.floor(F.col("piece_no") * F.col("_step"))
    hi = F.when(F.col("piece_no") == F.col("_n") - 1, F.col("_len")).otherwise(F.floor((F.col("piece_no") + 1) * F.col("_step")))
    rows = rows.withColumns({"lo": lo, "hi": hi})
    return rows.select("id", "piece_no", F.format_string("%s.%d_%d", "id", "lo", "hi").alias("piece_id"), F.substring("_seq", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("piece_seq"), "lo", "hi")


def split_totals(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(n, mean, longest) of sequences."""
    return seqs.agg(F.count("*").alias("n"), F.avg(F.length(seq)).alias("mean"), F.max(F.length(seq)).alias("longest"))
