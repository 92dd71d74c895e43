"""Running sums, dense ids and ranks over a whole table without a single-partition window over its rows.

For sums, rows are split into blocks of consecutive key values; a window over the blocks' totals (a row for each block) gives each
block's base, and windows within blocks do the rest.  Sums don't depend on partitioning, and no row order is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

BLOCK = 1 << 14


def running_sum(df: DataFrame, key: str, value: Column | str, into: str, before: list[Column] | None = None) -> DataFrame:
    """Adds the sum of value over the rows before each row, by (before..., key); key: a whole number, unique within before."""
    lead = [c.alias(f"_b{i}") for i, c in enumerate(before or [])]
    names = [f"_b{i}" for i in range(len(lead))]
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select("*", *lead, F.floor(F.col(key) / BLOCK).alias("_block"), value.alias("_value"))
    by = [*names, "_block"]
    totals = rows.groupBy(*by).agg(F.sum("_value").alias("_total"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    own = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    on = [out[n].eqNullSafe(base[n]) for n in by]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    joined = out.join(base, condition)
    return joined.select(*[out[c] for c in df.columns], (out["_own"] + base["_base"]).alias(into))


def dense_ids(df: DataFrame, key: str, into: str, before: list[Column] | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of (before..., key)."""
    return running_sum(df, key, F.lit(1).cast("long"), into, before).withColumn(into, F.col(into).cast("int"))


def ranked(df: DataFrame, by: list[tuple[Column | str, bool]], into: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of columns of any kind (each with: ascending?): ranges of the order are sorted and written, and a range's rows follow on those before it."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, (c, _) in enumerate(by)]
    order = [F.col(f"_k{i}").asc() if up else F.col(f"_k{i}").desc() for i, (_, up) in enumerate(by)]
    rows = df.select("*", *keys).repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns)
    # the id is the partition's number and, in 33 bits, the row's place in it
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_base") + place).alias(into))
