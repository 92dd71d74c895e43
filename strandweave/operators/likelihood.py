"""Log likelihood of an ordering under a Poisson model of contacts by separation.

Each pair of sequences is taken with all pairs of their bins.  The expected count of a pair of bins is a constant from DENSITY_LIMIT on,
so only sequences within that reach are paired one by one, by a join on stretches of the order; all other pairs of bins are counted, not
made.  What was observed is found from the observed cells, at any distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import DENSITY_FLOOR, DENSITY_LIMIT, contact_density, poisson_term
from ..functions.prefix import running_sum
from ..tables import written
from .contacts import map_weight


def placed_bins(state: DataFrame, grouped: DataFrame) -> DataFrame:
    """(seq_id, pos, ori, length, p, first_bin, centers): p is the length before the sequence in the order."""
    rows = state.join(grouped.select("seq_id", "first_bin", "n_bins", "edges"), "seq_id")
    width = F.element_at("edges", F.lit(2)) - F.element_at("edges", F.lit(1))
    centers = F.transform(F.slice("edges", F.lit(1), F.col("n_bins")), lambda lo: lo + width / 2 - F.col("length") / 2)
    return running_sum(rows, "pos", "length", "p").select("seq_id", "pos", "ori", "length", "p", "first_bin", centers.alias("centers"))


def _distance(low: str, high: str) -> Column:
    """Between bin centres (from the middles of their sequences) of a pair, low before high in the order."""
    between = F.col("high.p") - F.col("low.p") - F.col("low.length") + (F.col("low.length") + F.col("high.length")) / 2
    turned = F.col("low.seq_id") > F.col("high.seq_id")
    a, b = (F.when(turned, F.col(y)).otherwise(F.col(x)) for x, y in ((low, high), (high, low)))
    ori = lambda x: F.when(turned, F.col(f"{'high' if x == 'low' else 'low'}.ori")).otherwise(F.col(f"{x}.ori"))
    return between + ori("low") * b - ori("high") * a


def log_likelihood(extents: DataFrame, contacts: DataFrame, state: DataFrame, grouped: DataFrame, with_zero: bool = True) -> DataFrame:
    """(log_likelihood): extents and contacts are upper-triangle tables; expectations are shares of the symmetric contact map's weight."""
    total = map_weight(contacts).select(F.col("weight").cast("double").alias("_total"))
    bins = written(placed_bins(state, grouped).withColumn("_n", F.size("centers").cast("long")))
    # near: the gap between two sequences is below the limit, so the second begins in the stretch where the first ends or in the next
    end = F.floor((F.col("p") + F.col("length")) / DENSITY_LIMIT).cast("long")
    low = bins.select(F.struct("*").alias("low"), F.explode(F.array(end, end + 1)).alias("_s"))
    high = bins.select(F.struct("*").alias("high"), F.floor(F.col("p") / DENSITY_LIMIT).cast("long").alias("_s"))
    pairs = low.join(high, "_s").where((F.col("high.pos") > F.col("low.pos")) & (F.col("high.p") - F.col("low.p") - F.col("low.length") < DENSITY_LIMIT))
    cells = pairs.select("low", "high", F.explode("low.centers").alias("_x"), F.col("high.centers").alias("_ys")).select("low", "high", "_x", F.explode("_ys").alias("_y"))
    near = cells.agg(F.coalesce(F.sum(contact_density(_distance("_x", "_y"))), F.lit(0.0)).alias("_near"), F.count("*").alias("_n_near"))
    every = bins.agg(((F.pow(F.sum(F.col("_n").cast("decimal(19,0)")), F.lit(2)) - F.sum(F.col("_n") * F.col("_n"))) / 2).alias("_n_pairs"))
    # observed: the term without the expectation, which the sums above hold
    by_bin = bins.select(F.struct("*").alias("b"), F.posexplode("centers").alias("k", "c")).select((F.col("b.first_bin") + F.col("k")).alias("bin"), "c", F.col("b").dropFields("centers").alias("b"))
    seen = extents.where("n > 0").select("bi", "bj", "n")
    for x, side in (("bi", "u"), ("bj", "v")):
        seen = seen.join(by_bin.select(F.col("bin").alias(x), F.struct("b", "c").alias(side)), x)
    seen = seen.where("u.b.seq_id <> v.b.seq_id")
    first = F.col("u.b.pos") < F.col("v.b.pos")
    seen = seen.select("n", F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("z"))
    seen = seen.select("n", F.col("a.b").alias("low"), F.col("z.b").alias("high"), F.col("a.c").alias("_x"), F.col("z.c").alias("_y"))
    seen = seen.crossJoin(F.broadcast(total))  # one row
    expected = F.col("_total") * contact_density(_distance("_x", "_y"))
    observed = seen.agg(F.coalesce(F.sum(poisson_term("n", expected)), F.lit(0.0)).alias("_seen"), F.coalesce(F.sum(expected), F.lit(0.0)).alias("_expected"))
    sums = near.crossJoin(every).crossJoin(observed).crossJoin(total)  # one row each
    rest = F.col("_total") * (F.col("_near") + (F.coalesce(F.col("_n_pairs"), F.lit(0.0)) - F.col("_n_near")) * DENSITY_FLOOR) - F.col("_expected")
    out = F.col("_seen") - rest if with_zero else F.col("_seen")
    return sums.select(F.when(F.col("_n_pairs") > 0, out).alias("log_likelihood"))
