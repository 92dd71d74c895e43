"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrame operations.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


#: A vertex with more than a thousandth of all link ends is joined by broadcast: there are no more than that many.
HOT = 1000


def _star(links: DataFrame, large: bool, count: int) -> DataFrame:
    """large: every neighbour above a vertex is linked to the least of its neighbours and itself; else those below, and itself.  count: links, at most."""
    both = links.union(links.select("b", "a")).toDF("a", "b") if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    rows = both.join(F.broadcast(least.where(F.col("n") > 2 * count / HOT).select("a", "m")), "a", "left")
    rest = rows.where("m is null").select("a", "b").join(least.where(F.col("n") <= 2 * count / HOT).select("a", "m"), "a")
    out = rows.where("m is not null").unionByName(rest)
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): longs.  Returns (v, root) for each vertex with a link; root is the least vertex of its component.

    Self links and repeated links are allowed and change nothing; nulls are dropped; an empty table gives an empty one.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, count = None, now.count()
    while True:
        now = written(_star(_star(now, True, count), False, count))
        print_ = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if print_ == before or not print_[0]:
            break
        before = print_
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
